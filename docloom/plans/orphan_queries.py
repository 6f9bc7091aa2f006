"""Problem 4: references to records that do not exist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.orphans import bare_key, bare_name, orphans
from docloom.plans.registry import query
from docloom.session import table

_ENDS = r"[\s`''\".,:;\x{2018}\x{2019}\x{201c}\x{201d}\x{ab}\x{bb}]+"

_SQL = rf"""
    WITH s AS (SELECT DISTINCT lower(regexp_replace(id, '^\s+|\s+$', '', 'g')) AS k, added_at AS born, removed_at AS gone FROM sections),
    n AS (SELECT DISTINCT lower(regexp_replace(id, '^\s+|\s+$', '', 'g')) AS k, added_at AS born, removed_at AS gone FROM nodes),
    m AS (SELECT DISTINCT unnest([regexp_replace(regexp_replace(label, '^{_ENDS}|{_ENDS}$', '', 'g'), '(?s)\(.*', ''), source_file,
                                  regexp_extract(source_file, '[^/]*$')]) AS k, added_at AS born, removed_at AS gone FROM nodes),
    r AS (SELECT DISTINCT 'links' AS ref_table, 'section_id' AS ref_field, link_id AS row_id, built_at AS made,
                 lower(regexp_replace(section_id, '^\s+|\s+$', '', 'g')) AS k FROM links
          UNION SELECT 'links', 'node_id', link_id, built_at, lower(regexp_replace(node_id, '^\s+|\s+$', '', 'g')) FROM links
          UNION SELECT 'unresolved', 'mention', unresolved_id, built_at,
                       regexp_replace(regexp_replace(mention, '^{_ENDS}|{_ENDS}$', '', 'g'), '(?s)\(.*', '') FROM unresolved),
    found AS (SELECT ref_table, ref_field, row_id, strftime(made, '%Y-%m') AS period FROM r
        WHERE k IS NOT NULL AND made IS NOT NULL AND NOT EXISTS (
            SELECT 1 FROM (SELECT 'section_id' AS f, * FROM s UNION ALL SELECT 'node_id', * FROM n UNION ALL SELECT 'mention', * FROM m) p
            WHERE p.f = r.ref_field AND p.k = r.k AND coalesce(p.born, TIMESTAMP '0001-01-01') <= r.made AND coalesce(p.gone, TIMESTAMP '9999-01-01') > r.made))"""


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    links, nodes = table(spark, sf_dir, "links"), table(spark, sf_dir, "nodes")
    sections, unresolved = table(spark, sf_dir, "sections"), table(spark, sf_dir, "unresolved")
    life = lambda df, domain, key: df.select(F.lit(domain).alias("domain"), key.alias("key"), F.col("added_at").alias("born"), F.col("removed_at").alias("gone"))
    names = F.explode(F.array(bare_name(F.col("label")), F.col("source_file"), F.regexp_extract("source_file", "[^/]*$", 0)))
    lives = life(sections, "section_id", bare_key(F.col("id"))).union(life(nodes, "node_id", bare_key(F.col("id"))))
    lives = lives.union(nodes.select(F.lit("mention").alias("domain"), names.alias("key"), F.col("added_at").alias("born"), F.col("removed_at").alias("gone")))
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("domain"), bare_key(F.col(c)).alias("key")) for c in ("section_id", "node_id")]))
    refs = links.select(F.lit("links").alias("ref_table"), F.col("link_id").alias("row_id"), F.col("built_at").alias("at"), each.alias("r"))
    refs = refs.select("ref_table", "row_id", "at", "r.domain", "r.key").union(
        unresolved.select(F.lit("unresolved"), "unresolved_id", "built_at", F.lit("mention"), bare_name(F.col("mention")))
    )
    return orphans(refs, lives, ["ref_table", "row_id"]).select("ref_table", F.col("domain").alias("ref_field"), "row_id", "period").distinct()


@query("p4_found", _SQL + " SELECT DISTINCT * FROM found")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir)


@query("p4_by_period", _SQL + " SELECT ref_table, ref_field, period, count(DISTINCT row_id) AS orphans FROM found GROUP BY ALL")
def p4_by_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir).groupBy("ref_table", "ref_field", "period").agg(F.count("*").alias("orphans"))
