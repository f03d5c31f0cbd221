"""Ids, paths and the texts that similarity compares."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_path(path: Column) -> Column:
    return F.translate(path, "/\\.", "___")


def file_id(path: Column) -> Column:
    return F.concat(F.lit("file_"), clean_path(path))


def entity_id(path: Column, kind: Column, name: Column) -> Column:
    return F.concat_ws("_", clean_path(path), kind, name)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    """File name without its last suffix; a leading dot is no suffix."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def lower_first(text: Column) -> Column:
    return F.concat(F.lower(F.substring(text, 1, 1)), F.substring(text, 2, 2_000_000_000))


def _filled(label: str, value: Column) -> Column:
    return F.when(value != "", F.concat(F.lit(label), value))


#: Lengths at which the published texts are cut.
CODE_CUT, PROBLEM_CUT = 500, 2000


def entity_text(columns: Iterable[str], cut: int | None = CODE_CUT) -> Column:
    """``type: name | in file: path | ...`` with empty parts left out; ``cut=None`` keeps the whole code."""
    have = set(columns)

    def get(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit("")) if name in have else F.lit("")

    code = get("code")
    snippet = code if cut is None else F.when(F.length(code) > cut, F.concat(F.substring(code, 1, cut), F.lit("..."))).otherwise(code)
    return F.concat_ws(
        " | ",
        F.when(get("name") != "", F.concat(F.coalesce("type", F.lit("unknown")), F.lit(": "), get("name"))),
        _filled("in file: ", get("file_path")),
        _filled("signature: ", get("signature")),
        _filled("documentation: ", get("docstring")),
        _filled("code: ", snippet),
    )


def node_text(columns: Iterable[str]) -> Column:
    """Name, title, description, body and signature that a node carries, spaced."""
    have = set(columns)
    parts = [F.col(c) for c in ("name", "title", "description", "body", "signature") if c in have]
    return F.trim(F.concat_ws(" ", *parts))


def problem_text(text: Column, cut: int | None = PROBLEM_CUT) -> Column:
    """Whitespace normalised, cut with an ellipsis; ``cut=None`` keeps the whole text."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    if cut is None:
        return flat
    return F.when(F.length(flat) > cut, F.concat(F.substring(flat, 1, cut), F.lit("..."))).otherwise(flat)


def repository_from_url(url: Column) -> Column:
    """``struct(owner, name)`` of an https, ssh or ``owner/name`` reference, else null."""
    rest = F.regexp_replace(url, r"^(https://github\.com/|git@github\.com:)", "")
    rest = F.regexp_replace(F.regexp_replace(rest, r"\.git$", ""), r"^/+|/+$", "")
    parts = F.split(rest, "/")
    return F.when(
        (F.size(parts) >= 2) & ~rest.startswith("http"), F.struct(parts[0].alias("owner"), parts[1].alias("name"))
    )


def owner_and_name_from_folder(path: Column) -> Column:
    """Clone folders are called ``owner_name``: the last path part with an underscore, split once."""
    named = F.filter(F.split(path, "/"), lambda p: p.contains("_"))
    last = F.get(named, F.size(named) - 1)
    pieces = F.split(last, "_", 2)
    return F.when(last.isNotNull(), F.struct(pieces[0].alias("owner"), pieces[1].alias("name")))
