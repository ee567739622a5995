import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from symstream.operators import align, search
from symstream.operators.adaptive import SENTINEL, Adaptive
from symstream.plans import catalog


def norm(v):
    if isinstance(v, float):
        return None if v != v else round(v, 5)
    return v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, small, name):
    con = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    df = catalog.queries()[name](spark, small)
    columns = sorted(df.columns)
    got = sorted(repr([norm(x) for x in r]) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    result = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert got == sorted(repr([norm(r[names.index(c)]) for c in columns]) for r in result.fetchall())


def test_entry(spark):
    assert {"doc_id", "best"} <= set(entry.entry(spark).columns)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def lines_of(small):
    con = duckdb.connect()
    rows = con.execute(f"SELECT line_id, any_value(malayalam_lines), any_value(transliterated_lines) FROM read_parquet('{small}/evaluation.parquet') GROUP BY 1").fetchall()
    return {k: (a, b) for k, a, b in rows}


def test_codec_round_trip(spark, small):
    rows = catalog.queries()["codec_round_trip"](spark, small).collect()
    assert rows and all(r.same for r in rows)
    assert sum(r.coded_bytes for r in rows) < 0.6 * sum(r.n_bytes for r in rows)


def test_adaptive_bits(spark, small):
    rows = {r.line_id: r for r in catalog.queries()["adaptive_bits"](spark, small).collect()}
    texts = lines_of(small)
    assert set(rows) == set(texts)
    for k in sorted(texts)[::17]:
        data = list((texts[k][0] or "").encode())
        assert rows[k].symbols == len(data) and rows[k].bits == pytest.approx(Adaptive(3).cost([*data, SENTINEL]), abs=1e-3)


def test_edit_distance_lines(spark, small):
    def distance(a, b, substitute):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y) * substitute)
        return row[-1]

    latin = {r.line_id: r.latin for r in catalog.queries()["transliterate"](spark, small).collect()}
    texts, rows = lines_of(small), {r.line_id: r for r in catalog.queries()["edit_distance_lines"](spark, small).collect()}
    assert set(rows) == set(texts)
    for k in sorted(texts)[::9]:
        a, b = latin[k], texts[k][1]
        if a is None or b is None:
            assert rows[k].distance is None and rows[k].unit_distance is None
        elif len(a) * len(b) < 60_000:
            assert (rows[k].distance, rows[k].unit_distance) == (distance(a, b, 2), distance(a, b, 1))


def test_aligned_sentences(spark, small):
    import re

    cut = lambda t: [len(x) for x in re.split(r"(?<=[.!?\u0964])[ \t\n\x0b\f\r]+|\n+", t) if x]
    want = {}
    for a, b in lines_of(small).values():
        if a is not None and b is not None:
            for _, m, _, n, cost in align.align_lengths(cut(a), cut(b)):
                moves, total = want.get((m, n), (0, 0))
                want[m, n] = moves + 1, total + cost
    assert {(r.n_a, r.n_b): (r.moves, r.cost) for r in catalog.queries()["aligned_sentences"](spark, small).collect()} == want


def test_mark_languages(spark, small):
    """Stretches cover every line, one after another."""
    rows = catalog.queries()["mark_languages"](spark, small).collect()
    by = {}
    for r in rows:
        by.setdefault(r.line_id, []).append((r.start_pos, r.end_pos))
    texts = {k: a for k, (a, _) in lines_of(small).items() if a}
    assert set(by) == set(texts)
    for k, spans in by.items():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] == len(texts[k]) and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_markup_statistics(spark, small):
    want = {}
    for r in catalog.queries()["mark_languages"](spark, small).collect():
        n, stretches, switches = want.get(r.model, (0, 0, 0))
        want[r.model] = n + r.end_pos - r.start_pos, stretches + 1, switches + (r.start_pos > 0)
    assert {r.model: (r.symbols, r.stretches, r.switches) for r in catalog.queries()["markup_statistics"](spark, small).collect()} == want


@pytest.mark.parametrize("name", ["segment_lines", "correct_lines", "decode_keys"])
def test_searches(spark, small, name):
    rows = {r.line_id: r.out for r in catalog.queries()[name](spark, small).collect()}
    texts = {k: b.lower() for k, (_, b) in lines_of(small).items() if b is not None}
    assert set(rows) == set(texts)
    strip = lambda t: "".join(t.split())
    if name == "segment_lines":
        assert all(strip(rows[k]) == strip(t) for k, t in texts.items())
        assert sum(rows[k] == " ".join(t.split()) for k, t in texts.items()) > 0.05 * len(texts)
    if name == "decode_keys":
        key = {c: d for d, letters in search.KEYS.items() for c in letters}
        sent = {k: "   " + "".join({"\n": " "}.get(c, key.get(c, c)) for c in t if c in key or c in " .,\n") for k, t in texts.items()}
        assert all("".join(key.get(c, c) for c in rows[k]) == sent[k] for k in texts)
    if name == "correct_lines":
        assert all(set(rows[k]) <= set(t.replace("l", "i")) | set("lemi") for k, t in texts.items())
