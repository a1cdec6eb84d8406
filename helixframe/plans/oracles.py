"""SQL that states what the sequence operators compute, by positional substrings and joins."""

from __future__ import annotations

from ..functions.kernels import GappySpec, MismatchSpec, MotifSpec, Spec, motif_elements
from .fixtures import derived_sql


def with_(*ctes: tuple[str, str]) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({q})" for n, q in ctes) + "\n"


def windows(seqs: str, spec: Spec, width: int, pattern: str) -> str:
    # Cut at every offset j below the width: substr() at each position would scan long sequences again and again.
    seq = "seq" if spec.ignore_lower else "upper(seq)"
    cut = lambda c: f"regexp_extract_all(substr({c}, CAST(j + 1 AS INT)), '.{{{width}}}')"
    lists = f"SELECT seq_id, off, j, {cut(seq)} AS ws, {cut('annotation') if spec.annotated else 'NULL'} AS anns FROM {seqs}, range({width}) AS t(j)"
    rows = f"SELECT seq_id, CAST(j + 1 - off AS BIGINT) AS first, unnest(ws) AS w, {'unnest(anns)' if spec.annotated else 'NULL'} AS ann, unnest(range(len(ws))) AS turn FROM ({lists})"
    mask = " AND ann NOT LIKE '%-%'" if spec.annotated else ""
    return f"SELECT seq_id, first + turn * {width} AS pos, w, ann FROM ({rows}) WHERE regexp_full_match(w, '{pattern}'){mask}"


def reverse_complement(w: str, spec: Spec) -> str:
    a, b = spec.letters.pairs
    return f"least({w}, reverse(translate({w}, '{a}', '{b}')))"


def occurrences(seqs: str, spec: Spec) -> str:
    letters = spec.letters.char_class
    if isinstance(spec, MotifSpec):
        parts = []
        for m in spec.motifs:
            e = motif_elements(m)
            ann = " || ".join(["''"] + [("'.'" if x == "." else f"substr(ann, {i}, 1)") for i, x in enumerate(e, 1)]) if spec.annotated else "''"
            parts.append(f"SELECT seq_id, pos, '{m}' || {ann} AS feature FROM ({windows(seqs, spec, len(e), spec.pattern(m))})")
        return " UNION ALL ".join(parts)
    if isinstance(spec, GappySpec):
        parts, k = [], spec.k
        for g in range(spec.m + 1):
            both = f"substr(w, 1, {k}) || substr(w, {k + g + 1}, {k})"
            both = reverse_complement(f"({both})", spec) if spec.rev_complement else f"({both})"
            ann = f" || substr(ann, 1, {k}) || '{'.' * g}' || substr(ann, {k + g + 1}, {k})" if spec.annotated else ""
            parts.append(f"SELECT seq_id, pos, substr({both}, 1, {k}) || '{'.' * g}' || substr({both}, {k + 1}, {k}){ann} AS feature FROM ({windows(seqs, spec, 2 * k + g, f'{letters}{{{2 * k + g}}}')})")
        return " UNION ALL ".join(parts)
    f = reverse_complement("w", spec) if spec.rev_complement else "w"
    return f"SELECT seq_id, pos, {f}{' || ann' if spec.annotated else ''} AS feature FROM ({windows(seqs, spec, spec.k, f'{letters}{{{spec.k}}}')})"


def neighbour_table(spec: MismatchSpec, kmers: str) -> str:
    """(w, feature) of k-mers and all k-mers at a Hamming distance of at most m, from the product of the letters."""
    letters = ", ".join(f"('{c}')" for c in spec.letters.letters)
    tables = ", ".join(f"(VALUES {letters}) AS t{i}(c{i})" for i in range(spec.k))
    universe = f"SELECT {' || '.join(f'c{i}' for i in range(spec.k))} AS feature FROM {tables}"
    distance = " + ".join(f"CAST(substr(w, {i}, 1) <> substr(feature, {i}, 1) AS INT)" for i in range(1, spec.k + 1))
    return f"SELECT w, feature FROM (SELECT DISTINCT w FROM {kmers}), ({universe}) WHERE {distance} <= {spec.m}"


def counts(seqs: str, spec: Spec) -> str:
    n = "1" if spec.presence else "count(*)"
    if isinstance(spec, MismatchSpec):
        w = windows(seqs, spec, spec.k, f"{spec.letters.char_class}{{{spec.k}}}")
        return f"SELECT seq_id, feature, CAST({n} AS BIGINT) AS n FROM ({w}) k JOIN ({neighbour_table(spec, f'({w})')}) t ON k.w = t.w GROUP BY ALL".replace("SELECT seq_id, feature, CAST(1 AS BIGINT) AS n", "SELECT DISTINCT seq_id, feature, CAST(1 AS BIGINT) AS n").replace(" GROUP BY ALL", "" if spec.presence else " GROUP BY seq_id, feature")
    return f"SELECT seq_id, feature, CAST({n} AS BIGINT) AS n FROM ({occurrences(seqs, spec)}) GROUP BY seq_id, feature"


def rep(cnt: str, normalized: bool = True) -> str:
    v = "n / sqrt(CAST(sum(n * n) OVER (PARTITION BY seq_id) AS DOUBLE))" if normalized else "CAST(n AS DOUBLE)"
    return f"SELECT seq_id, feature, {v} AS v FROM {cnt}"


def rep_query(source: str, form: str, spec: Spec) -> str:
    return with_(("s", derived_sql(source, form)), ("c", counts("s", spec)), ("e", rep("c", spec.normalized))) + "SELECT seq_id, feature, round(v, 6) AS v FROM e"


def kernel(cnt: str, spec: Spec, other: str | None = None) -> str:
    """(x_id, y_id, v) of position-independent counts."""
    o = other or cnt
    dot = f"SELECT a.seq_id AS x_id, b.seq_id AS y_id, CAST(sum(a.n * b.n) AS BIGINT) AS v FROM {cnt} a JOIN {o} b USING (feature) GROUP BY ALL"
    if not spec.normalized:
        return f"SELECT x_id, y_id, CAST(v AS DOUBLE) AS v FROM ({dot})"
    norm = lambda c: f"(SELECT seq_id, sqrt(CAST(sum(n * n) AS DOUBLE)) AS s FROM {c} GROUP BY seq_id)"
    same = "CASE WHEN x_id = y_id THEN 1.0 ELSE v / p.s / q.s END" if other is None else "v / p.s / q.s"
    return f"SELECT x_id, y_id, {same} AS v FROM ({dot}) d JOIN {norm(cnt)} p ON p.seq_id = x_id JOIN {norm(o)} q ON q.seq_id = y_id"


def positional_kernel(occ: str, spec: Spec, weights: list[str]) -> str:
    """weights: SQL for each distance."""
    table = ", ".join(f"({d}, {w})" for d, w in enumerate(weights))
    raw = f"SELECT a.seq_id AS x_id, b.seq_id AS y_id, sum(e.w) AS v FROM {occ} a JOIN {occ} b ON a.feature = b.feature JOIN (SELECT d, CAST(w AS DOUBLE) AS w FROM (VALUES {table}) AS t(d, w)) e ON abs(a.pos - b.pos) = e.d WHERE e.w <> 0 GROUP BY 1, 2"
    if not spec.normalized:
        return raw
    norm = f"(SELECT x_id AS seq_id, sqrt(v) AS s FROM ({raw}) WHERE x_id = y_id)"
    return f"SELECT x_id, y_id, CASE WHEN x_id = y_id THEN 1.0 ELSE v / p.s / q.s END AS v FROM ({raw}) d JOIN {norm} p ON p.seq_id = x_id JOIN {norm} q ON q.seq_id = y_id"
