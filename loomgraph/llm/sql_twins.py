"""DuckDB forms of this subpackage's queries where SQL can express them."""

from __future__ import annotations

from loomgraph.llm import license_scan
from loomgraph.llm import quality_mcd as mcd

_D = len(mcd._XS)


def _inverse_root_sql(source: str, prefix: str) -> str:
    """Chained CTEs from means and covariances to the rows of the inverse Cholesky factor."""
    steps, last = [], source
    entries = []
    for i in range(_D):
        for j in range(i + 1):
            rest = "".join(f" + l{i}{k} * l{j}{k}" for k in range(j))
            inner = f"c{i}{j} - (0.0::DOUBLE{rest})"
            entries.append((f"l{i}{j}", f"sqrt({inner})" if i == j else f"({inner}) / l{j}{j}"))
    for j in range(_D):
        for i in range(j, _D):
            rest = "".join(f" + l{i}{k} * w{k}{j}" for k in range(j, i))
            entries.append((f"w{i}{j}", f"({1.0 if i == j else 0.0}::DOUBLE - (0.0::DOUBLE{rest})) / l{i}{i}"))
    for n, (name, value) in enumerate(entries):
        steps.append(f"{prefix}_{n} AS (SELECT *, {value} AS {name} FROM {last})")
        last = f"{prefix}_{n}"
    root = " * ".join(f"l{i}{i}" for i in range(_D))
    values = ", ".join(mcd._ESTIMATE)
    return ",\n".join([*steps, f"{prefix} AS MATERIALIZED (SELECT elang, esource, start, ({root}) * ({root}) AS det, {values} FROM {last})"])


def _distance_sql() -> str:
    zs = [" + ".join(f"f.w{i}{j} * (v.{mcd._XS[j]} / {mcd.SCALE}.0::DOUBLE - f.m{j})" for j in range(i + 1)) for i in range(_D)]
    return " + ".join(f"({z}) * ({z})" for z in zs)


def _starts_sql() -> list[str]:
    """Medians, deviations and the four first estimates."""
    d, xs = range(_D), mcd._XS
    spread = lambda i: f"({mcd.NORMAL_MAD}::DOUBLE * a{i} / {mcd.SCALE}.0::DOUBLE)"
    fixed = lambda i, value: f"CAST(floor(({value}) * {mcd.SCALE}.0::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS u{i}"
    forms = [
        lambda i: f"CAST(sign(z{i}) AS DOUBLE)",
        lambda i: f"greatest(-{mcd.WINSOR}::DOUBLE, least({mcd.WINSOR}::DOUBLE, z{i}))",
        lambda i: f"CASE WHEN norm > 0 THEN z{i} / norm ELSE 0.0::DOUBLE END",
    ]
    means = ", ".join(f"m{i}" for i in d)
    moment = lambda i, j: f"(p{i}{j} / n / {mcd.SCALE * mcd.SCALE}.0::DOUBLE + {mcd.RIDGE if i == j else 0.0}::DOUBLE)"
    return [
        "medians AS (SELECT elang, esource, " + ", ".join(f"quantile_disc({x}, 0.5) AS q{i}" for i, x in enumerate(xs)) + " FROM vectors GROUP BY ALL)",
        "aways AS (SELECT elang, esource, " + ", ".join(f"max(q{i}) AS q{i}" for i in d) + ", "
        + ", ".join(f"quantile_disc(abs({x} - q{i}), 0.5) AS a{i}" for i, x in enumerate(xs))
        + " FROM vectors JOIN medians USING (elang, esource) GROUP BY elang, esource)",
        "scales AS MATERIALIZED (SELECT elang, esource, " + ", ".join(f"q{i} / {mcd.SCALE}.0::DOUBLE AS m{i}" for i in d) + ", "
        + ", ".join(f"sqrt({spread(i)} * {spread(i)} + {mcd.FLOORS[x] ** 2}::DOUBLE) AS s{i}" for i, x in enumerate(xs)) + " FROM aways)",
        "zs AS (SELECT elang, esource, " + ", ".join(f"({x} / {mcd.SCALE}.0::DOUBLE - m{i}) / s{i} AS z{i}" for i, x in enumerate(xs))
        + " FROM vectors JOIN scales USING (elang, esource))",
        "normed AS MATERIALIZED (SELECT *, sqrt(" + " + ".join(f"z{i} * z{i}" for i in d) + ") AS norm FROM zs)",
        "shapes AS (" + " UNION ALL ".join(
            f"SELECT elang, esource, {n} AS start, " + ", ".join(fixed(i, form(i)) for i in d) + " FROM normed" for n, form in enumerate(forms, 1)
        ) + ")",
        "shape_sums AS (SELECT elang, esource, start, CAST(count(*) AS DOUBLE) AS n, "
        + ", ".join(f"CAST(sum(u{i} * u{j}) AS DOUBLE) AS p{i}{j}" for i, j in mcd._PAIRS) + " FROM shapes GROUP BY elang, esource, start)",
        f"starts AS (SELECT elang, esource, start, {means}, " + ", ".join(f"s{i} * s{j} * {moment(i, j)} AS c{i}{j}" for i, j in mcd._PAIRS)
        + f" FROM shape_sums JOIN scales USING (elang, esource) UNION ALL SELECT elang, esource, 0, {means}, "
        + ", ".join(f"s{i} * s{i}" if i == j else "0.0::DOUBLE" for i, j in mcd._PAIRS) + " FROM scales)",
    ]


def _concentrated_sql(found: str, name: str) -> list[str]:
    """One concentration step from the estimates ``found``."""
    xs, on = ", ".join(mcd._XS), "USING (elang, esource, start)"
    mean = [f"(s{i} / n / {mcd.SCALE}.0::DOUBLE)" for i in range(_D)]
    cov = {(i, j): f"{mcd.CONSISTENCY}::DOUBLE * (p{i}{j} / n / {mcd.SCALE * mcd.SCALE}.0::DOUBLE - {mean[i]} * {mean[j]})" for i, j in mcd._PAIRS}
    floors = {i: f" + {mcd.FLOORS[x] ** 2}::DOUBLE" for i, x in enumerate(mcd._XS)}
    return [
        f"""{name}_near AS MATERIALIZED (SELECT elang, esource, start, {xs}, CAST(floor(256.0::DOUBLE * ln(1.0::DOUBLE + ({_distance_sql()}))) AS BIGINT) AS r
        FROM vectors v JOIN {found} f USING (elang, esource))""",
        f"{name}_radius AS (SELECT elang, esource, start, quantile_disc(r, {mcd.CORE_SHARE}) AS radius FROM {name}_near GROUP BY elang, esource, start)",
        f"{name}_sums AS (SELECT elang, esource, start, CAST(count(*) AS DOUBLE) AS n, "
        + ", ".join(f"CAST(sum({x}) AS DOUBLE) AS s{i}" for i, x in enumerate(mcd._XS)) + ", "
        + ", ".join(f"CAST(sum({mcd._XS[i]} * {mcd._XS[j]}) AS DOUBLE) AS p{i}{j}" for i, j in mcd._PAIRS)
        + f" FROM {name}_near JOIN {name}_radius {on} WHERE r <= radius GROUP BY elang, esource, start)",
        f"{name}_moments AS (SELECT elang, esource, start, " + ", ".join(f"{m} AS m{i}" for i, m in enumerate(mean)) + ", "
        + ", ".join(f"{cov[i, j]}{floors[i] if i == j else ''} AS c{i}{j}" for i, j in mcd._PAIRS) + f" FROM {name}_sums)",
        _inverse_root_sql(f"{name}_moments", name),
    ]


def quality_sql() -> str:
    def log(inner: str) -> str:
        return f"CAST(floor(ln({inner}) * {mcd.SCALE} + 0.5) AS BIGINT)"

    n = "CAST(n_words AS DOUBLE)"
    values = [f"word_chars / {n}", *[f"1.0::DOUBLE + 100.0::DOUBLE * {c} / {n}" for c in ("n_symbols", "n_dup_lines", "n_repeat_words")], n]
    vector = ", ".join(f"{log(v)} AS {x}" for v, x in zip(values, mcd._XS, strict=True))
    on = "USING (elang, esource)"
    ctes = [
        r"""texts AS (SELECT doc_id, lang, source, coalesce(text, '') AS t,
            regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents)""",
        f"""windows AS (SELECT doc_id, unnest(list_transform(generate_series(1, len(ws) - {mcd.WINDOW - 1}), lambda i:
            array_to_string(ws[i:i + {mcd.WINDOW - 1}], ' '))) AS g, unnest(generate_series(1, len(ws) - {mcd.WINDOW - 1})) AS i
            FROM texts WHERE len(ws) >= {mcd.WINDOW})""",
        "again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM windows) WHERE c > 1)",
        f"""covered AS (SELECT doc_id, sum(part) AS n_repeat_words FROM (SELECT doc_id,
            least({mcd.WINDOW}, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, {mcd.WINDOW})) AS part FROM again) GROUP BY doc_id)""",
        r"""split AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM texts)""",
        f"""counts AS (SELECT t.doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words,
            CAST(coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0) AS BIGINT) AS word_chars,
            CAST(length(t) - length(translate(t, '{mcd._SYMBOLS}', '')) AS BIGINT) AS n_symbols,
            CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
            CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
            FROM texts t JOIN split USING (doc_id) LEFT JOIN covered USING (doc_id))""",
        f"""judged AS (SELECT *, coalesce('=' || lang, 'null') AS glang, coalesce('=' || source, 'null') AS gsource,
            n_words < {mcd.MIN_WORDS} OR 100 * n_repeat_words > {mcd.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM counts)""",
        f"plain AS (SELECT doc_id, glang, gsource, {vector} FROM judged WHERE NOT base_failed)",
        "sizes AS (SELECT glang, gsource, count(*) AS n FROM plain GROUP BY ALL)",
        f"languages AS (SELECT glang, sum(n) AS small_n FROM sizes WHERE n < {mcd.MIN_GROUP} GROUP BY glang)",
        f"""keys AS (SELECT glang, gsource, CASE WHEN n >= {mcd.MIN_GROUP} OR coalesce(small_n >= {mcd.MIN_GROUP}, false) THEN glang ELSE '*' END AS elang,
            CASE WHEN n >= {mcd.MIN_GROUP} THEN gsource ELSE '*' END AS esource FROM sizes LEFT JOIN languages USING (glang))""",
        "vectors AS MATERIALIZED (SELECT * FROM plain JOIN keys USING (glang, gsource))",
        *_starts_sql(),
        _inverse_root_sql("starts", "start_estimates"),
    ]
    last = "start_estimates"
    for step in range(mcd.SCREEN_STEPS):
        ctes += _concentrated_sql(last, f"screen{step}")
        last = f"screen{step}"
    values = ["start", "det", *mcd._ESTIMATE]
    ctes.append(f"best0 AS (SELECT elang, esource, {', '.join(values)} FROM {last} QUALIFY row_number() OVER (PARTITION BY elang, esource ORDER BY det, start) = 1)")
    for step in range(mcd.MOST_STEPS):
        ctes += _concentrated_sql(f"best{step}", f"after{step}")
        chosen = ", ".join(f"CASE WHEN n.det < {mcd.FALL}::DOUBLE * o.det THEN n.{v} ELSE o.{v} END AS {v}" for v in values)
        ctes.append(f"best{step + 1} AS MATERIALIZED (SELECT elang, esource, {chosen} FROM best{step} o JOIN after{step} n {on})")
    ctes.append(f"verdicts AS (SELECT doc_id, ({_distance_sql()}) <= {mcd.CUTOFF}::DOUBLE AS kept FROM vectors v JOIN best{mcd.MOST_STEPS} f {on})")
    return "WITH " + ",\n".join(ctes) + f"""
        SELECT doc_id, {', '.join(mcd.COUNTS)}, base_failed, coalesce(v.kept, false) AS kept FROM judged LEFT JOIN verdicts v USING (doc_id)"""


def license_sql() -> str:
    """Containment in every window of every text, without signatures."""
    rows = []
    for name, text in license_scan.TEMPLATES.items():
        words = license_scan.template_words(text)
        parts = dict.fromkeys(" ".join(words[i : i + 5]) for i in range(len(words) - 4))
        rows += [f"('{name}', {license_scan.stride_of(len(parts))}, {len(parts)}, '{p}')" for p in parts]
    return f"""WITH templates(license, stride, n, part) AS (VALUES {', '.join(rows)}),
        texts AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS ws FROM documents),
        parts AS (SELECT doc_id, unnest(list_transform(generate_series(1, len(ws) - 4), lambda i: array_to_string(ws[i:i + 4], ' '))) AS part,
            unnest(generate_series(0, len(ws) - 5)) AS p FROM texts WHERE len(ws) >= 5),
        hits AS (SELECT doc_id, license, stride, n, part, p // stride AS w FROM parts JOIN templates USING (part)),
        placed AS (SELECT doc_id, license, stride, n, part, w FROM hits UNION SELECT doc_id, license, stride, n, part, w - 1 FROM hits WHERE w > 0),
        counted AS (SELECT doc_id, license, stride, n, w, count(DISTINCT part) AS c FROM placed GROUP BY ALL HAVING count(DISTINCT part) >= {license_scan.CONTAINMENT} * n)
        SELECT doc_id, license, max(c) AS n_matched, CAST(n AS BIGINT) AS n_template, CAST(min(w * stride) AS BIGINT) AS first_word
        FROM counted GROUP BY doc_id, license, n"""


def merkle_sql() -> str:
    """Trees by recursion over levels, proofs by a walk over them; CRC-32 from its polynomial."""
    enc = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')"
    cells = " || ".join(enc(c) for c in ("doc_id", "source", "lang", "n_chars"))
    return f"""
WITH RECURSIVE bits AS (
  SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY n) AS t
  FROM (SELECT CAST(range AS BIGINT) AS n FROM range(256))),
sums AS (SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS crc FROM documents, bits),
d AS (SELECT doc_id, coalesce('=' || source, '') AS g, sha256({cells} || {enc("text")}) AS leaf,
  sha256({cells} || CASE WHEN crc % 2 = 0 THEN {enc("replace(text, chr(10), '')")} ELSE {enc("text")} END) AS other FROM sums),
n AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d),
up(g, lvl, i, h, n) AS (
  SELECT g, 0, i, leaf, count(*) OVER (PARTITION BY g) FROM n
  UNION ALL SELECT g, lvl + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (max(n) + 2) // 3 FROM up WHERE n > 1 GROUP BY g, lvl, i // 3),
subroots AS (SELECT g, lvl AS top, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS s FROM up WHERE n = 1),
over(lvl, i, h, n) AS (
  SELECT 0, s, subroot, count(*) OVER () FROM subroots
  UNION ALL SELECT lvl + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (max(n) + 2) // 3 FROM over WHERE n > 1 GROUP BY lvl, i // 3),
whole AS (SELECT g, lvl, i, h, n FROM up UNION ALL SELECT NULL, lvl, i, h, n FROM over),
sib AS (SELECT g, lvl, i,
    coalesce(string_agg(h, '') OVER (PARTITION BY g, lvl, i // 3 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(h, '') OVER (PARTITION BY g, lvl, i // 3 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM whole WHERE n > 1),
walk(g, id, tree, lvl, i, h, proof) AS (
  SELECT g, i, g, 0, i, other, '' FROM n
  UNION ALL
  SELECT w.g, id, CASE WHEN tree IS NOT NULL AND w.lvl = t.top THEN NULL ELSE tree END,
    CASE WHEN tree IS NOT NULL AND w.lvl = t.top THEN 0 ELSE w.lvl + 1 END,
    CASE WHEN tree IS NOT NULL AND w.lvl = t.top THEN t.s ELSE w.i // 3 END,
    CASE WHEN tree IS NOT NULL AND w.lvl = t.top THEN w.h ELSE sha256(sib.l || w.h || sib.r) END,
    CASE WHEN tree IS NOT NULL AND w.lvl = t.top THEN proof ELSE proof || sib.l || sib.r END
  FROM walk AS w JOIN subroots AS t ON w.g = t.g
  LEFT JOIN sib ON sib.g IS NOT DISTINCT FROM w.tree AND sib.lvl = w.lvl AND sib.i = w.i
  WHERE tree IS NOT NULL OR sib.i IS NOT NULL),
done AS (SELECT g, id, arg_max(h, lvl) AS folded_root, arg_max(proof, lvl) AS proof FROM walk WHERE tree IS NULL GROUP BY g, id)
SELECT doc_id, leaf, subroot, o.h AS root, sha256(proof) AS proof_sha256, folded_root, folded_root = o.h AS verified
FROM n JOIN subroots USING (g) JOIN done ON done.g = n.g AND done.id = n.i, over AS o WHERE o.n = 1"""


def lexical_sql() -> str:
    """Scores by a join of the terms of items and documents."""
    found = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (SELECT doc_id, unnest({found}) AS t FROM documents),
n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
s AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM n),
tf AS (SELECT doc_id, t, count(*) AS tf FROM d GROUP BY doc_id, t),
w AS (SELECT t, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, s GROUP BY t, docs),
i AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest({found}) AS t FROM benchmark) GROUP BY item_id, t),
r AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // terms))))::BIGINT AS score
  FROM i JOIN tf USING (t) JOIN w USING (t) JOIN n USING (doc_id), s GROUP BY item_id, doc_id),
o AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM o WHERE rank <= 10"""
