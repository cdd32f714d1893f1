"""Collections derived from relational tables, for queries and benchmarks.

The statements use only SQL that Spark and DuckDB read alike, so that both sides of a comparison start from equal documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .shared import spread

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: Every text as a plain Markdown file: bundle = source, path = language/id.
PLAIN = """SELECT coalesce(source, 'none') AS bundle, coalesce(lang, 'xx') || '/' || CAST(doc_id AS STRING) || '.md' AS path, coalesce(text, '') AS source FROM documents"""

_NL = "chr(10)"


def _head(*pairs: tuple[str, str]) -> str:
    lines = " || ".join(f"'{k}: ' || {v} || {_NL}" for k, v in pairs)
    return f"'---' || {_NL} || {lines} || '---' || {_NL} || {_NL}"


def _row(bundle: str, path: str, source: str, table: str) -> str:
    return f"SELECT '{bundle}' AS bundle, {path} AS path, {source} AS source FROM {table}"


def _key(column: str) -> str:
    return f"CAST({column} AS STRING)"


#: A catalogue with frontmatter, sections, fences, links of all kinds, ids that collide within and across bundles, and navigation files.
CATALOG = " UNION ALL ".join(
    [
        _row("geo", f"'regions/' || {_key('r_regionkey')} || '.md'", _head(("type", "'Sales Region'"), ("title", "r_name"), ("description", "'The region ' || r_name || ' and its nations.'")) + f" || '# Schema' || {_NL} || 'Key ' || {_key('r_regionkey')} || '.' || {_NL} || '# Schema' || {_NL} || 'Again.' || {_NL}", "region"),
        _row(
            "geo",
            f"'nations/' || {_key('n_nationkey')} || '.md'",
            _head(("type", "'Nation  Table'"), ("title", "n_name"), ("grain", "'nation_key'"))
            + f" || 'Nation ' || n_name || ' lies in a region! See it.' || {_NL} || {_NL} || '# Schema' || {_NL} || '```sql' || {_NL} || '# not a heading' || {_NL} || '```' || {_NL} || '## Joins' || {_NL}"
            + f" || 'In [region](../regions/' || {_key('n_regionkey')} || '.md), by [self](./' || {_key('n_nationkey')} || '.md), [gone](missing_' || {_key('n_nationkey')} || '), [web](https://example.com/x.md), [top](#joins), [root](/regions/' || {_key('n_regionkey')} || '.md#schema \"Region\"), [coded](../../regions/%30).' || {_NL}",
            "nation",
        ),
        _row("geo", "'index.md'", f"'# Geography' || {_NL} || 'Regions and nations.' || {_NL}", "region WHERE r_regionkey = 0"),
        _row(
            "sales",
            f"'customers/' || {_key('c_custkey')} || '.md'",
            _head(
                ("type", "'Customer'"),
                ("title", "c_name"),
                ("description", "'Customer ' || c_name || ' of the segment ' || lower(c_mktsegment) || ', who buys from nation number ' || CAST(c_nationkey AS STRING) || ' and is kept here with a summary that is long enough to be cut.'"),
                ("status", "CASE c_custkey % 4 WHEN 0 THEN 'Current' WHEN 1 THEN 'draft' WHEN 2 THEN 'deprecated' ELSE 'under  review' END"),
                ("stale_after", f"CASE c_custkey % 3 WHEN 0 THEN '2024-06-01' WHEN 1 THEN '2030-01-01' ELSE 'soon' END"),
            )
            + f" || '# Profile' || {_NL} || 'Segment ' || c_mktsegment || '.' || {_NL} || '# Orders' || {_NL} || 'Bought on credit.' || {_NL} || '### profile' || {_NL} || 'More.' || {_NL}",
            "customer",
        ),
        _row(
            "sales",
            f"'orders/' || {_key('o_orderkey')} || '.md'",
            _head(("type", "'Order'"), ("title", f"'Order ' || {_key('o_orderkey')}"), ("grain", "'order_id'"), ("stale_after", "CASE WHEN o_orderkey % 2 = 0 THEN '2024-01-15' ELSE '2031-01-15' END"))
            + f" || 'Order with priority ' || o_orderpriority || ' and state ' || o_orderstatus || '. Placed once.' || {_NL} || '## Joins' || {_NL} || 'By [customer](../customers/' || {_key('o_custkey')} || ') and [next](' || {_key('o_orderkey + 1')} || '.md).' || {_NL}",
            "orders",
        ),
        _row("supply", f"'suppliers/' || {_key('s_suppkey')} || '.md'", f"'# ' || s_name || {_NL} || {_NL} || '> quoted' || {_NL} || 'A supplier without frontmatter' || {_NL} || {_NL} || '## Nation' || {_NL} || 'Number ' || {_key('s_nationkey')} || ', of [geo](../regions/0.md).' || {_NL}", "supplier"),
        _row("supply", f"'parts/' || {_key('p_partkey')} || '.md'", _head(("title", "p_name"), ("description", "'Part ' || p_name || ' of brand ' || p_brand || '.'")) + f" || 'Size ' || {_key('p_size')} || ' [maker](../suppliers/' || {_key('p_partkey % 100')} || '.md)' || {_NL}", "part"),
        _row("supply", "'parts/log.md'", f"'moved' || {_NL}", "region WHERE r_regionkey = 1"),
    ]
)

#: A concept for each conversation, a section for each turn.
CHAT = f"""SELECT 'chat' AS bundle, 'conversations/' || CAST(conv_id AS STRING) || '.md' AS path,
  {{join}} AS source FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id"""
CHAT_DUCK = CHAT.format(join="string_agg('## ' || role || chr(10) || text || chr(10), '' ORDER BY turn)")
CHAT_SPARK = CHAT.format(join="array_join(transform(array_sort(collect_list(struct(turn, '## ' || role || chr(10) || text || chr(10) AS line))), x -> x.line), '')")


def register_tables(spark: SparkSession, sf_dir: str) -> None:
    for t in TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def corpus(spark: SparkSession, sf_dir: str, statement: str) -> DataFrame:
    """The documents of ``statement`` over the tables of ``sf_dir``, on all cores however small those are."""
    import re

    for t in TABLES:
        if re.search(rf"\b{t}\b", statement):
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spread(spark.sql(statement))
