"""Every registered query of the library against its SQL."""

import duckdb
import pytest

from compare import canonical
from vociflow.plans import catalog

#: Queries that SQL does not express, and the tests that hold them against known or brute-force results.
TESTED_ELSEWHERE = {
    "stems": "test_functions.test_stems", "near_dup_pairs": "test_functions.test_near_pairs_equal_all_pairs", "near_dup_edges": "test_catalog.test_near_edges_are_first_links",
    "boot_two_level_ci": "test_functions.test_bootstrap_of_counts_equals_that_of_rows, test_bootstrap_draws", "ci_width": "test_bootstrap_draws",
}


def test_queries_without_sql_are_tested_elsewhere():
    assert set(catalog.QUERIES) - set(catalog.SQL) == set(TESTED_ELSEWHERE)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query(spark, duck, sf_dir, name):
    assert canonical(catalog.QUERIES[name](spark, sf_dir)) == canonical(duck.execute(catalog.SQL[name]))


def test_near_edges_are_first_links(spark, sf_dir):
    """Of all pairs of relevant long texts that are no exact copies, each text keeps the one with the earliest partner."""
    rows = {r["id"]: r for r in catalog._tokens(spark, sf_dir).where("own_text_length >= 100").collect()}
    copies = {r["duplicate_id"] for r in catalog.exact_dup_edges(spark, sf_dir).collect()}
    able = sorted((r for i, r in rows.items() if i not in copies), key=lambda r: (r["published_at"], r["id"]))

    def similarity(a, b):
        before = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            now = [i]
            for j, y in enumerate(b, 1):
                now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y)))
            before = now
        return 1 - before[-1] / max(len(a), len(b))

    expected = {}
    for j, b in enumerate(able):
        for a in able[:j]:
            near = (b["published_at"] - a["published_at"]).total_seconds() <= 72 * 3600
            sizes = sorted((len(a["tokens"]), len(b["tokens"])))
            if near and sizes[0] >= 0.9 * sizes[1] > 0 and len(set(a["tokens"]) ^ set(b["tokens"])) <= 0.2 * sizes[1] and similarity(a["tokens"], b["tokens"]) >= 0.9 - 1e-12:
                expected[b["id"]] = a["id"]
                break
    found = {r["duplicate_id"]: r["canonical_id"] for r in catalog.near_dup_edges(spark, sf_dir).collect()}
    assert found == expected


#: Of seven authors' topic posts, other posts and views, the second one's topical score is the median, but for its rounding.
_AT_MEDIAN = zip((1, 3, 4, 1, 2, 3, 6), (4, 7, 0, 2, 3, 7, 4), (300, 300, 300, 0, 300, 400, 400), strict=True)
_TIED = ", ".join(
    f"({k}, '{kind}', {value})"
    for k, (topic, other, views) in enumerate(_AT_MEDIAN, 1)
    for kind, value in [("view", views)] * (views > 0) + [("purchase", 1)] * (topic - (views > 0)) + [("click", 1)] * other
)
ODD_TABLES = {
    "tied": {
        "customer": "SELECT * REPLACE (0.5 AS c_acctbal) FROM base WHERE c_custkey BETWEEN 1 AND 7",
        "events": f"SELECT row_number() OVER () AS event_id, TIMESTAMP '2024-01-25' AS ts, k AS user_id, kind AS event_type, value::DOUBLE AS value, '{{\"k\": 1}}' AS props FROM (VALUES {_TIED}) v(k, kind, value)",
    },
    "repeated authors": {"customer": "FROM base UNION ALL FROM base WHERE c_custkey < 9"},
    "less than a second late": {"events": "SELECT * REPLACE (CASE WHEN event_id % 3 = 0 THEN TIMESTAMP '2024-01-31 00:00:00.25' WHEN event_id % 3 = 1 THEN TIMESTAMP '2024-01-31' ELSE ts END AS ts) FROM base"},
}


@pytest.mark.parametrize("odd", ODD_TABLES)
@pytest.mark.parametrize("name", ["json_export", "json_export_lines"])
def test_exports_of_odd_tables(spark, sf_dir, tmp_path, name, odd):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in ("customer", "events", "lineitem"):
        made = f"WITH base AS (FROM '{sf_dir}/{t}.parquet') " + ODD_TABLES[odd].get(t, "FROM base")
        con.execute(f"COPY ({made}) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS FROM '{tmp_path}/{t}.parquet'")
    assert canonical(catalog.QUERIES[name](spark, str(tmp_path))) == canonical(con.execute(catalog.SQL[name]))
