import os

import pytest

from symstream.llm import encoding, queries

COLUMNS = {
    "p1_found": {"line_id", "field_name"},
    "p2_found": {"line_id_a", "line_id_b"},
    "p3_found": {"rec_id_a", "rec_id_b"},
    "p4_found": {"table_name", "keep_id", "copy_id"},
    "p5_found": {"line_id", "field_name", "lang"},
    "p6_found": {"line_id", "start_pos", "end_pos"},
    "p7_ids": {"doc_id", "ids"},
    "p9_found": {"doc_id"},
}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_runs(spark, small, name):
    if name[:2] in ("p7", "p8") and not os.path.exists(encoding.RANKS):
        pytest.skip("no rank file here")
    df = queries.queries()[name](spark, small)
    rows = df.collect()
    if name in COLUMNS:
        assert set(df.columns) == COLUMNS[name]
    if name == "p7_round_trip":
        assert not rows
    elif name.endswith("_found") and name != "p9_found":
        assert rows and len(rows) == len(set(rows))


def test_shares(spark, small):
    if not os.path.exists(encoding.RANKS):
        pytest.skip("no rank file here")
    rows = queries.queries()["p8_shares"](spark, small).collect()
    assert abs(sum(r.share_reached for r in rows) - 1) < 1e-9 and all(r.most_copies <= r.max_repeats for r in rows)
