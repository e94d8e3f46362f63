"""Queries over the data-quality operators (Q1-Q12, Q14)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from slicelake.operators import audit, quality
from slicelake.operators.lifecycle import SOURCE, TARGET
from slicelake.plans import views as v
from slicelake.plans.aggregates import INDEX, index_columns
from slicelake.plans.joins import VISIBLE
from slicelake.plans.lists import DIFF, EXPECTED, HEADERS, headers
from slicelake.plans.registry import query


@query(
    "Q1_header_conformance",
    v.sql(
        """SELECT file, CASE WHEN list_contains(header, 'QUANTITY') THEN 'CSV has duplicate column names when compared case-insensitively: Quantity, QUANTITY.'
             ELSE concat('CSV columns do not match target table (', concat_ws('; ',
               CASE WHEN len(missing) > 0 THEN concat('missing: ', array_to_string(missing, ', ')) END,
               CASE WHEN len(unknown) > 0 THEN concat('unknown: ', array_to_string(unknown, ', ')) END), ').') END AS message
           FROM diff JOIN headers USING (file, header) WHERE len(missing) + len(unknown) > 0 OR list_contains(header, 'QUANTITY')""".replace(
            "FROM diff JOIN headers USING (file, header)", "FROM (SELECT d.*, h.header FROM d JOIN headers h USING (file))"
        ),
        "obj_event", headers=HEADERS, d=DIFF.replace("SELECT file, header,", "SELECT file,"),
    ),
)
def header_conformance(spark, sf_dir):
    return quality.header_findings(headers(spark, sf_dir), F.array(*[F.lit(c) for c in EXPECTED]))


@query(
    "Q2_import_header_conformance",
    """WITH h AS (SELECT p_partkey AS file, CASE p_partkey % 5 WHEN 0 THEN [] WHEN 1 THEN ['Id', p_name, 'I D'] WHEN 2 THEN ['Part Name', 'part-name']
          WHEN 3 THEN ['id', repeat('x', 65)] ELSE ['1st', p_brand, ''] END AS header FROM part)
       SELECT file, CASE file % 5 WHEN 0 THEN 'CSV must contain a header row.' WHEN 2 THEN 'CSV headers become duplicates after normalization.'
         ELSE 'Invalid CSV column name: use letters, numbers, and underscores; start with a letter.' END AS message
       FROM h WHERE file % 5 IN (0, 2, 3)""",
)
def import_header_conformance(spark, sf_dir):
    kind = F.col("p_partkey") % 5
    cells = lambda *c: F.array(*c)
    header = (
        F.when(kind == 0, F.array().cast("array<string>"))
        .when(kind == 1, cells(F.lit("Id"), F.col("p_name"), F.lit("I D")))
        .when(kind == 2, cells(F.lit("Part Name"), F.lit("part-name")))
        .when(kind == 3, cells(F.lit("id"), F.repeat(F.lit("x"), 65)))
        .otherwise(cells(F.lit("1st"), F.col("p_brand"), F.lit("")))
    )
    part = v.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("file"), header.alias("header"))
    return quality.import_header_findings(part)


RECORD = """concat(l_orderkey, ',"a ""quoted"", cell",', l_quantity, CASE WHEN l_partkey % 7 = 0 THEN ',more' ELSE '' END,
    CASE WHEN l_partkey % 5 = 0 THEN '' ELSE ',end' END)"""


@query(
    "Q3_row_arity",
    """SELECT finding, cells, count(*) AS rows FROM (SELECT CASE WHEN cells > 4 THEN 'surplus' ELSE 'short' END AS finding, cells FROM
         (SELECT CAST(3 + CASE WHEN l_partkey % 7 = 0 THEN 1 ELSE 0 END + CASE WHEN l_partkey % 5 = 0 THEN 0 ELSE 1 END AS BIGINT) AS cells FROM lineitem)
       WHERE cells <> 4) GROUP BY ALL""",
)
def row_arity(spark, sf_dir):
    rows = v.table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", f"{RECORD} AS _record")
    found = quality.arity_findings(rows, F.lit(4))
    return found.groupBy("finding", "cells").agg(F.count(F.lit(1)).alias("rows"))


CELLS = """SELECT l_orderkey % 1000 AS file, row_number() OVER (PARTITION BY l_orderkey % 1000 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) + 1 AS row_no,
    CASE WHEN l_partkey % 13 = 0 THEN '  ' ELSE CAST(l_partkey AS VARCHAR) END AS part_key,
    CASE WHEN l_suppkey % 11 = 0 THEN '' ELSE CAST(l_suppkey AS VARCHAR) END AS supp_key,
    CASE WHEN l_linenumber = 7 THEN concat(l_linenumber, 'x') ELSE CAST(l_linenumber AS VARCHAR) END AS line_text,
    CASE WHEN l_quantity > 49 THEN 'many' WHEN l_quantity < 2 THEN '' ELSE CAST(l_quantity AS VARCHAR) END AS quantity_text, l_returnflag, l_linestatus
    FROM lineitem"""


def cells(spark, sf_dir) -> DataFrame:
    """Order lines as text rows of a thousand files."""
    from slicelake.operators import skew

    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    rows = v.table(spark, sf_dir, "lineitem").withColumn("file", F.col("l_orderkey") % 1000)
    numbered = skew.rank_rows(rows, ["file"], [F.col(c) for c in order], skew.seq_block("l_orderkey"), "row_no")
    text = lambda c: F.col(c).cast("string")
    return numbered.select(
        "file",
        (F.col("row_no") + 1).alias("row_no"),
        F.when(F.col("l_partkey") % 13 == 0, "  ").otherwise(text("l_partkey")).alias("part_key"),
        F.when(F.col("l_suppkey") % 11 == 0, "").otherwise(text("l_suppkey")).alias("supp_key"),
        F.when(F.col("l_linenumber") == 7, F.concat("l_linenumber", F.lit("x"))).otherwise(text("l_linenumber")).alias("line_text"),
        F.when(F.col("l_quantity") > 49, "many").when(F.col("l_quantity") < 2, "").otherwise(text("l_quantity")).alias("quantity_text"),
        "l_returnflag", "l_linestatus",
    )


@query(
    "Q4_blank_keys",
    v.sql(
        """SELECT file, row_no, "column", concat('CSV row ', row_no, ' has no value for primary-key column ''', "column", '''. Primary-key values must not be null.') AS message
           FROM (SELECT file, row_no, CASE WHEN trim(part_key) = '' THEN 'part_key' ELSE 'supp_key' END AS "column" FROM cells
                 WHERE trim(part_key) = '' OR trim(supp_key) = '' QUALIFY row_number() OVER (PARTITION BY file ORDER BY row_no) = 1)""",
        cells=CELLS,
    ),
)
def blank_keys(spark, sf_dir):
    return quality.blank_key_findings(cells(spark, sf_dir), ["part_key", "supp_key"])


@query(
    "Q5_cast_findings",
    v.sql(
        """SELECT "column", value, count(*) AS cells FROM
           (SELECT 'line_text' AS "column", line_text AS value FROM cells WHERE line_text LIKE '%x'
            UNION ALL SELECT 'quantity_text', quantity_text FROM cells WHERE quantity_text = 'many'
            UNION ALL SELECT 'part_key', part_key FROM cells WHERE trim(part_key) = '') GROUP BY ALL""",
        cells=CELLS,
    ),
)
def cast_findings(spark, sf_dir):
    types = {"line_text": "int", "quantity_text": "decimal(38,10)", "part_key": "bigint"}
    found = quality.cast_findings(cells(spark, sf_dir), types, ["file", "row_no"])
    return found.groupBy("column", "value").agg(F.count(F.lit(1)).alias("cells"))


@query(
    "Q6_length_findings",
    """SELECT "column", doc_id, length FROM (SELECT 'text' AS "column", doc_id, CAST(length(text) AS BIGINT) AS length FROM documents WHERE length(text) > 512
       UNION ALL SELECT 'source', doc_id, CAST(length(source) AS BIGINT) FROM documents WHERE length(source) > 4)""",
)
def length_findings(spark, sf_dir):
    docs = v.table(spark, sf_dir, "documents")
    found = quality.length_findings(docs, {"text": 512, "source": 4}, ["doc_id"])
    return found.select("column", "doc_id", F.length("value").cast("bigint").alias("length"))


@query(
    "Q7_stage_purity",
    v.sql(
        """SELECT attempt, count(*) AS foreign_rows FROM contents WHERE l_suppkey % 53 = 0 GROUP BY attempt""",
        "contents",
    ),
)
def stage_purity(spark, sf_dir):
    staged = v.contents(spark, sf_dir).withColumn("expected_batch", F.col("batch_num")).withColumn(
        "batch_num", F.when(F.col("l_suppkey") % 53 == 0, 0).otherwise(F.col("batch_num"))
    )
    return quality.stage_purity(staged)


@query(
    "Q8_duplicate_keys",
    "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1",
)
def duplicate_keys(spark, sf_dir):
    return quality.duplicate_keys(v.table(spark, sf_dir, "lineitem"), ["l_linenumber"], ["l_orderkey"])


@query(
    "Q9_overlapping_records",
    v.sql(
        f"""SELECT target_database, target_table, l_partkey, CAST(min(batch_num) AS BIGINT) AS lowest_batch, CAST(max(batch_num) AS BIGINT) AS highest_batch
            FROM ({VISIBLE}) GROUP BY ALL HAVING count(DISTINCT batch_num) > 1""",
        "contents", "registry",
    ),
)
def overlapping_records(spark, sf_dir):
    shown = audit.visible_rows(v.contents(spark, sf_dir), v.registry(spark, sf_dir))
    return quality.overlapping_records(shown, ["l_partkey"])


@query(
    "Q10_target_contract",
    v.sql(
        """SELECT target_database, target_table, finding FROM (
             SELECT 'mart' AS target_database, concat('t_', p_partkey) AS target_table, unnest(list_filter([
               CASE WHEN p_partkey % 10 = 0 THEN 'does not exist' END,
               CASE WHEN p_partkey % 10 <> 0 AND p_partkey % 4 = 0 THEN 'must have an invisible batch_num column' END,
               CASE WHEN p_partkey % 10 <> 0 AND p_partkey % 7 = 0 THEN 'must use LIST partitioning by batch_num' END,
               CASE WHEN b.target_table IS NOT NULL THEN 'every unique key must include batch_num' END,
               CASE WHEN p_partkey % 10 <> 0 AND p_partkey % 9 = 0 THEN 'has no CSV-loadable columns' END], lambda x: x IS NOT NULL)) AS finding
             FROM part LEFT JOIN (SELECT DISTINCT target_table FROM (SELECT target_table, index_name FROM ix GROUP BY ALL
               HAVING NOT bool_or(lower(column_name) = 'batch_num'))) b ON b.target_table = concat('t_', p_partkey))""",
        ix=INDEX,
    ),
)
def target_contract(spark, sf_dir):
    part = v.table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    table = F.concat(F.lit("t_"), key).alias("target_table")
    name = F.col("column_name")
    catalog = (
        part.where(key % 10 != 0)
        .select(F.lit("mart").alias("target_database"), table, key, F.explode(F.array(*[F.lit(c) for c in ("id", "code", "batch_num")])).alias("column_name"))
        .withColumns(
            {
                "hidden": F.when(name == "batch_num", key % 4 != 0).otherwise(False),
                "generated": (name != "batch_num") & (key % 9 == 0),
                "partition_column": (name == "batch_num") & (key % 7 != 0),
            }
        )
    )
    mappings = part.select(key.alias("id"), F.lit("mart").alias("target_database"), table)
    return quality.target_findings(mappings, catalog, index_columns(spark, sf_dir))


@query(
    "Q10_moved_mappings",
    v.sql(
        """SELECT DISTINCT target_database, target_table, 'mapping now points elsewhere' AS finding FROM registry WHERE mapping_id IN (3, 6)""",
        "registry",
    ),
)
def moved_mappings(spark, sf_dir):
    """Slices whose mapping was pointed at another table after they were created."""
    registry = v.registry(spark, sf_dir)
    now = v.mapping(spark).withColumn(
        "target_table", F.when(F.col("id").isin(3, 6), "elsewhere").otherwise(F.col("target_table"))
    )
    catalog = now.select(
        *TARGET, F.explode(F.array(F.lit("id"), F.lit("batch_num"))).alias("column_name")
    ).distinct().withColumns(
        {
            "hidden": F.col("column_name") == "batch_num", "generated": F.lit(False),
            "partition_column": F.col("column_name") == "batch_num",
        }
    )
    indexes = now.select(*TARGET, F.lit("PRIMARY").alias("index_name"), F.lit("batch_num").alias("column_name")).distinct()
    return quality.target_findings(now, catalog, indexes, registry)


@query(
    "Q11_count_findings",
    v.sql(
        f"""SELECT CAST(e.mapping_id AS BIGINT) AS mapping_id, e.bucket_name, e.resource_name, coalesce(e.rows, 0) AS expected_rows, coalesce(a.rows, 0) AS actual_rows
            FROM (SELECT mapping_id, bucket_name, resource_name, count(*) AS rows FROM contents GROUP BY ALL) e
            LEFT JOIN (SELECT mapping_id, bucket_name, resource_name, count(*) AS rows FROM ({VISIBLE}) GROUP BY ALL) a
            USING (mapping_id, bucket_name, resource_name) WHERE e.rows <> coalesce(a.rows, 0)""",
        "contents", "registry",
    ),
)
def count_findings(spark, sf_dir):
    data = v.contents(spark, sf_dir)
    rows = lambda df: df.groupBy(*SOURCE).agg(F.count(F.lit(1)).alias("rows"))
    return quality.count_findings(rows(data), rows(audit.visible_rows(data, v.registry(spark, sf_dir))), SOURCE)


@query(
    "Q12_mapping_findings",
    v.sql(
        """SELECT id, finding FROM (SELECT id, unnest(list_filter([
             CASE WHEN m NOT IN ('SYNC', 'DETACHED') THEN 'Invocation mode must be SYNC or DETACHED.' END,
             CASE WHEN w IS NULL THEN 'Worker threads must be a whole number from 1 to 64.' END,
             CASE WHEN w NOT BETWEEN 1 AND 64 THEN 'Worker threads must be from 1 to 64.' END,
             CASE WHEN trim(compartment_name) = '' THEN 'Compartment name is required.' END,
             CASE WHEN length(bucket_name) > 255 THEN 'Bucket name must be 255 characters or fewer.' END,
             CASE WHEN NOT regexp_full_match(target_database, '[A-Za-z][A-Za-z0-9_]{0,63}') THEN 'Invalid target database.' END,
             CASE WHEN NOT regexp_full_match(ltrim(target_table, '.'), '[A-Za-z][A-Za-z0-9_]{0,63}') THEN 'Invalid target table.' END],
             lambda x: x IS NOT NULL)) AS finding
           FROM (SELECT *, CASE WHEN invocation_mode = '' THEN 'SYNC' ELSE upper(invocation_mode) END AS m,
                   try_cast(CASE WHEN worker_threads = '' THEN '4' ELSE worker_threads END AS INT) AS w FROM forms))""",
        "forms",
    ),
)
def mapping_findings(spark, sf_dir):
    return quality.mapping_findings(v.mapping_forms(spark, sf_dir))


@query(
    "Q14_delimiter_profile",
    """SELECT p_partkey AS file, CASE p_partkey % 5 WHEN 0 THEN ',' WHEN 1 THEN ';' WHEN 2 THEN chr(9) WHEN 3 THEN '|' ELSE ',' END AS delimiter
       FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem)""",
)
def delimiter_profile(spark, sf_dir):
    """Order lines written with a delimiter per part; one group uses none consistently."""
    kind = F.col("l_partkey") % 5
    mark = F.when(kind == 1, ";").when(kind == 2, "\t").when(kind == 3, "|").otherwise(",")
    line = F.concat_ws(" ", F.col("l_returnflag"), F.lit('"a,b;c"'))
    text = F.concat("l_orderkey", mark, line, mark, "l_linenumber")
    ragged = F.concat(F.repeat(F.lit("; "), F.col("l_linenumber")), F.col("l_returnflag"))
    lines = v.table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("file"), F.when(kind == 4, ragged).otherwise(text).alias("line")
    )
    return quality.delimiter_profile(lines)
