"""``python -m loomgraph PATH [--artifacts FILE] [--output DIR] [--problem TEXT]``"""

from __future__ import annotations

import argparse
import json
import logging

from loomgraph.api import KnowledgeBase
from loomgraph.session import build_session


def main() -> None:
    parser = argparse.ArgumentParser(prog="loomgraph", description="Analyse a source tree as a knowledge graph")
    parser.add_argument("path", help="source tree, any path Spark can read")
    parser.add_argument("--artifacts", help="JSON documents with repository, pulls, issues and commits")
    parser.add_argument("--output", help="folder for the graph and its JSON-lines snapshot")
    parser.add_argument("--incremental", action="store_true", help="go on from the graph saved in the output folder")
    parser.add_argument("--published", action="store_true", help="follow the published rules to the letter")
    parser.add_argument("--problem", help="rank entities for this text")
    parser.add_argument("--log-level", default="INFO", choices=["DEBUG", "INFO", "WARNING", "ERROR"])
    options = parser.parse_args()
    logging.basicConfig(level=options.log_level)
    log = logging.getLogger("loomgraph")

    base = KnowledgeBase(build_session(), published=options.published)
    if options.incremental and options.output:
        base.open(f"{options.output}/graph")
        log.info(json.dumps(base.update_project(options.path)))
    else:
        log.info(json.dumps(base.analyze_project(options.path, options.artifacts, lambda n, s: log.info("step %d: %s", n, s))))
    if options.output:
        base.save(f"{options.output}/graph")
        base.export(f"{options.output}/snapshot")
    if options.problem:
        base.relevance(options.problem).show(truncate=60)


if __name__ == "__main__":
    main()
