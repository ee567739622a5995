"""SQL that says what the relational models compute, for any order: text for DuckDB."""

from __future__ import annotations


def _length(gram: str, sep: str) -> str:
    return f"len(string_split({gram}, '{sep}'))" if sep else f"length({gram})"


def _context(gram: str, k: int, sep: str) -> str:
    if not sep:
        return f"substr({gram}, length({gram}) - {k}, {k})"
    return f"array_to_string(list_slice(string_split({gram}, '{sep}'), len(string_split({gram}, '{sep}')) - {k}, len(string_split({gram}, '{sep}')) - 1), '{sep}')" if k else "''"


def _symbol(gram: str, sep: str) -> str:
    return f"string_split({gram}, '{sep}')[-1]" if sep else f"right({gram}, 1)"


def _tail(context: str, sep: str) -> str:
    return f"array_to_string(list_slice(string_split({context}, '{sep}'), 2, len(string_split({context}, '{sep}'))), '{sep}')" if sep else f"substr({context}, 2)"


def model_ctes(source: str, order: int, name: str = "") -> str:
    """Common tables sw (model, k, ctx, sym, n, weight) and c (model, k, ctx, occurrences, types, mass, below) of texts.

    source: a query or table with the columns model and text. name: put behind the names of the tables.
    """
    grams = f"SELECT model, substr(text, greatest(i - {order}, 1)::INT, least(i, {order + 1})::INT) AS gram FROM (SELECT model, text, unnest(generate_series(1, length(text))) AS i FROM {source} WHERE text IS NOT NULL AND model IS NOT NULL)"
    return f"gc{name} AS (SELECT model, gram, count(*) AS n FROM (" + grams + ") GROUP BY 1, 2),\n" + from_grams(order, name=name)


def from_grams(order: int, sep: str = "", name: str = "") -> str:
    """The same from a table gc (model, gram, n). sep: what stands between the symbols of a gram, if they aren't single signs."""
    levels = " UNION ALL ".join(f"SELECT model, {k} AS k, {_context('gram', k, sep)} AS ctx, {_symbol('gram', sep)} AS sym, sum(n)::BIGINT AS n FROM gc{name} WHERE {_length('gram', sep)} > {k} GROUP BY ALL" for k in range(order + 1))
    return f"""s{name} AS ({levels}),
sw{name} AS (SELECT *, 2 * n - 1 AS weight FROM s{name}),
b{name} AS (SELECT h.model, h.k, h.ctx, sum(l.weight)::BIGINT AS below FROM sw{name} h JOIN sw{name} l ON h.model = l.model AND h.sym = l.sym AND h.k = l.k + 1 AND {_tail('h.ctx', sep)} = l.ctx GROUP BY ALL),
c{name} AS (SELECT sw.model, sw.k, sw.ctx, sum(n)::BIGINT AS occurrences, count(*) AS types, sum(weight)::BIGINT AS mass, coalesce(max(below), 0) AS below FROM sw{name} sw LEFT JOIN b{name} b ON sw.model = b.model AND sw.k = b.k AND sw.ctx = b.ctx GROUP BY 1, 2, 3)"""


def bits_cte(order: int, alphabet: int = 65536, sep: str = "", name: str = "", rest: bool = True) -> str:
    """Common table gb (gram, model, bits, found) of the grams of a table d (gram). rest: a symbol that no context knows costs its place in the
    rest of the alphabet.
    """
    joins = " ".join(
        f"LEFT JOIN c{name} c{k} ON c{k}.k = {k} AND {_length('d.gram', sep)} > {k} AND c{k}.model = c0.model AND c{k}.ctx = {_context('d.gram', k, sep)}" if k else f"JOIN c{name} c0 ON c0.k = 0"
        for k in range(order + 1)
    ) + " " + " ".join(f"LEFT JOIN sw{name} s{k} ON s{k}.k = {k} AND {_length('d.gram', sep)} > {k} AND s{k}.model = c0.model AND s{k}.ctx = {_context('d.gram', k, sep)} AND s{k}.sym = {_symbol('d.gram', sep)}" for k in range(order + 1))
    columns = ", ".join(f"coalesce(c{k}.occurrences >= 2, false) OR {k} = 0 AS u{k}, c{k}.types AS t{k}, c{k}.mass AS m{k}, c{k}.below AS e{k}, s{k}.weight AS w{k}" for k in range(order + 1))
    cost = f"log2(greatest({alphabet} - t0 + 1, 1)::DOUBLE)" if rest else "0"
    for k in range(order + 1):
        left = f"(m{k} - {f'CASE WHEN u{k + 1} THEN e{k + 1} ELSE 0 END' if k < order else 0})"
        cost = f"(CASE WHEN u{k} AND w{k} IS NOT NULL THEN -log2(w{k}::DOUBLE / ({left} + t{k})) WHEN u{k} AND {left} > 0 THEN -log2(t{k}::DOUBLE / ({left} + t{k})) + {cost} ELSE {cost} END)"
    level, alone = "-1", f"log2(greatest({alphabet} - t0 + 1, 1)::DOUBLE)"
    for k in range(order + 1):
        left = f"(m{k} - {f'CASE WHEN u{k + 1} THEN e{k + 1} ELSE 0 END' if k < order else 0})"
        level = f"(CASE WHEN u{k} AND w{k} IS NOT NULL THEN {k} ELSE {level} END)"
        alone = f"(CASE WHEN u{k} AND w{k} IS NOT NULL THEN -log2(w{k}::DOUBLE / {left}) ELSE {alone} END)"
    return f"x{name} AS (SELECT d.gram, c0.model, {columns} FROM d{name} d {joins}),\ngb{name} AS (SELECT gram, model, {cost} AS bits, w0 IS NOT NULL AS found, {level} AS level, {alone} AS alone FROM x{name})"


def track(source: str, texts: str, ids: str, order: int, alphabet: int = 65536) -> str:
    """WITH clause up to track (ids, pos, sym, model, bits): texts, a query with the columns ids and text, under the models of source."""
    return f"""WITH {model_ctes(source, order)},
e AS (SELECT {ids}, i, substr(text, greatest(i - {order}, 1)::INT, least(i, {order + 1})::INT) AS gram FROM (SELECT {ids}, text, unnest(generate_series(1, length(text))) AS i FROM {texts} WHERE text IS NOT NULL)),
d AS (SELECT DISTINCT gram FROM e),
{bits_cte(order, alphabet)},
track AS (SELECT {ids}, e.i - 1 AS pos, right(e.gram, 1) AS sym, gb.model, gb.bits FROM e JOIN gb USING (gram))"""
