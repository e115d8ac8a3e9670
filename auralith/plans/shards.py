"""Shard and schedule queries: chunking (W3), merge groups (W5), dense re-index (W2), missing shards (S4/J6/U4),
retention (W7/O3), latest snapshot (A13), epoch shard plan (W8), seeded shuffle (O4), resume skip (O5), paired
batches (J8/A16) and the step schedule (A5).

Order-dependent steps use ``dense_index`` (range partitioned, per-partition offsets), never a global single-task
window; group-level results are aggregates, never collected lists.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auralith.operators import ordering as O
from auralith.plans.tables import table
from auralith.session import cut_lineage

NUM_CHUNKS = 10
MERGE_WIDTH = 10
N_CHUNK_TABLES = 82
SHARD_CATALOG = {"tiny": 1, "small": 12, "medium": 116, "large": 579, "all": 4095}  # fixed: files per subset
KEEP_NEWEST = 5
PLAN_GROUPS = 40
EPOCHS = 2
SEED = 42
BATCH = 32
SKIP_BATCHES = 3
ACCUM = 2


def shard_name(i) -> F.Column:
    """``{:03x}.tar`` (lower hex, at least three digits, never truncated)."""
    h = F.lower(F.hex(i))
    return F.concat(F.when(F.length(h) >= 3, h).otherwise(F.lpad(h, 3, "0")), F.lit(".tar"))


def chunk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W3 over orders in key order: chunk sizes and key ranges."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    n = orders.count()
    idx = O.dense_index(orders, ["o_orderkey"])
    ch = idx.withColumn("chunk_id", O.chunk_ids(F.col("row_idx"), n, NUM_CHUNKS))
    return ch.groupBy("chunk_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key")
    )


def merge_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """82 chunk tables (chunk = o_orderkey % 82 + 1) merged ten at a time into ``split_k``."""
    orders = table(spark, sf_dir, "orders")
    chunk = (F.col("o_orderkey") % N_CHUNK_TABLES + 1).alias("chunk_id")
    grouped = orders.select(chunk, "o_totalprice").withColumn(
        "split_id", F.floor((F.col("chunk_id") - 1) / MERGE_WIDTH).cast("long")
    )
    return grouped.groupBy("split_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct("chunk_id").alias("n_chunks"),
        F.min("chunk_id").alias("first_chunk"),
        F.max("chunk_id").alias("last_chunk"),
    )


def dense_reindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct subset names ``subset_<p_size % 13>.<p_partkey % 3>`` numbered in lexicographic order."""
    part = table(spark, sf_dir, "part")
    names = part.select(
        F.concat(F.lit("subset_"), (F.col("p_size") % 13).cast("string"), F.lit("."), (F.col("p_partkey") % 3).cast("string")).alias("name")
    ).distinct()
    return O.dense_index(names, ["name"], name="subset_idx")


def missing_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S4 + J6/U4: catalog 'all' (4095 shards) minus the shards present (shard = o_custkey % 4095 of every order)."""
    present = table(spark, sf_dir, "orders").select(shard_name(F.col("o_custkey") % SHARD_CATALOG["all"]).alias("shard")).distinct()
    expected = spark.range(SHARD_CATALOG["all"]).select(F.col("id").alias("shard_idx"), shard_name(F.col("id")).alias("shard"))
    return expected.join(present, "shard", "left_anti")


def _checkpoints(spark, sf_dir) -> DataFrame:
    """Snapshot names ``checkpoint-<step>`` for every distinct lineitem order key with a returned line."""
    li = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == "R")
    names = li.select(F.concat(F.lit("checkpoint-"), F.col("l_orderkey").cast("string")).alias("name")).distinct()
    return names.withColumn("step", F.regexp_extract("name", "checkpoint-(\\d+)", 1).cast("long"))


def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delete list = every snapshot except the newest ``KEEP_NEWEST`` by numeric step (O3)."""
    ck = cut_lineage(_checkpoints(spark, sf_dir))  # read for the threshold and for the list
    cutoff = O.top_n_threshold(ck, "step", KEEP_NEWEST)
    return ck.where(F.lit(cutoff).isNotNull() & (F.col("step") < F.lit(cutoff))) if cutoff is not None else ck.limit(0)


def latest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arg-max of the numeric step."""
    ck = _checkpoints(spark, sf_dir)
    return ck.agg(F.max_by("name", "step").alias("name"), F.max("step").alias("step"))


def shard_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per epoch, shuffle the ja subsets (parts) and the en subsets (customers) with a seeded key, cut each into
    groups of ``n // 40``, keep the first 40 groups; slot i of ja pairs with slot i of en (long form, no pairs)."""

    def side(df: DataFrame, key: str, label: str) -> DataFrame:
        n = df.count()
        size = n // PLAN_GROUPS
        if size == 0:
            raise ValueError(f"shard plan: {label} has fewer than {PLAN_GROUPS} subsets")
        rows = df.select(F.col(key).alias("member"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(EPOCHS - 1).cast("long"))).alias("epoch"))
        rows = rows.withColumn("k", O.seeded_key(F.col("member"), F.col("epoch"), F.lit(SEED)))
        idx = O.dense_index(rows, ["epoch", "k", "member"], drop=("k",))
        pos = F.col("row_idx") - F.col("epoch") * F.lit(n)
        out = idx.withColumn("slot", F.floor(pos / size).cast("long")).withColumn("rank_in_slot", (pos % size).cast("long"))
        return out.where(F.col("slot") < PLAN_GROUPS).select(F.lit(label).alias("side"), "epoch", "slot", "rank_in_slot", "member")

    ja = side(table(spark, sf_dir, "part"), "p_partkey", "ja")
    en = side(table(spark, sf_dir, "customer"), "c_custkey", "en")
    return ja.unionByName(en)


def seeded_shuffle(spark: SparkSession, sf_dir: str, epochs: int = EPOCHS) -> DataFrame:
    """Per-epoch reproducible permutation of customers, position = rank of md5(id:epoch:seed)."""
    cust = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("member"))
    n = cust.count()
    rows = cust.select("member", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(epochs - 1).cast("long"))).alias("epoch"))
    rows = rows.withColumn("k", O.seeded_key(F.col("member"), F.col("epoch"), F.lit(SEED)))
    idx = O.dense_index(rows, ["epoch", "k", "member"], drop=("k",))
    return idx.select("epoch", (F.col("row_idx") - F.col("epoch") * F.lit(n)).alias("position"), "member")


def resume_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epoch-0 order of ``seeded_shuffle`` with the first ``SKIP_BATCHES`` batches of ``BATCH`` rows skipped."""
    s = seeded_shuffle(spark, sf_dir, epochs=1)
    b = F.floor(F.col("position") / BATCH).cast("long")
    return s.withColumn("batch_id", b).where(F.col("batch_id") >= SKIP_BATCHES).drop("epoch")


def paired_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J8 + A16: customers and suppliers shuffled (seeded), batched at ``BATCH // 2`` each; batch i of one table is
    paired with batch i of the other, stopping at the shorter table (long form: one row per member)."""
    half = BATCH // 2

    def side(df: DataFrame, key: str, label: str) -> DataFrame:
        rows = df.select(F.col(key).alias("member")).withColumn("k", O.seeded_key(F.col("member"), F.lit(0), F.lit(SEED)))
        idx = O.dense_index(rows, ["k", "member"], drop=("k",))
        return idx.select(F.lit(label).alias("side"), F.floor(F.col("row_idx") / half).cast("long").alias("batch_id"),
                          (F.col("row_idx") % half).alias("pos_in_batch"), "member")

    c = side(table(spark, sf_dir, "customer"), "c_custkey", "customer")
    s = side(table(spark, sf_dir, "supplier"), "s_suppkey", "supplier")
    # only complete batches take part (the reference's loader drops an incomplete last batch of a side)
    full = lambda d: d.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == half).select("batch_id")
    common = full(c).join(full(s), "batch_id")
    return c.unionByName(s).join(common, "batch_id", "left_semi")


def step_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: steps per epoch = n // (batch * accum), total = steps * epochs, paired size = min(n1, n2) * 2.
    Both counts come from one tagged union pivoted into a single row (no join of the two aggregates)."""
    tagged = table(spark, sf_dir, "customer").select(F.lit("n1").alias("k")).unionByName(
        table(spark, sf_dir, "supplier").select(F.lit("n2").alias("k")))
    j = tagged.groupBy().pivot("k", ["n1", "n2"]).count()
    steps = F.floor(F.col("n1") / F.lit(BATCH * ACCUM)).cast("long")
    return j.select(
        "n1", "n2", steps.alias("steps_per_epoch"), (steps * EPOCHS).alias("total_steps"),
        (F.least("n1", "n2") * 2).alias("paired_rows"),
    )


# ---- oracles ------------------------------------------------------------------------------------------------------
def _sql_shard(x: str) -> str:
    return f"(CASE WHEN length(lower(hex({x}))) >= 3 THEN lower(hex({x})) ELSE lpad(lower(hex({x})), 3, '0') END || '.tar')"


_CK = """ck AS (SELECT DISTINCT 'checkpoint-' || l_orderkey AS name FROM lineitem WHERE l_returnflag = 'R'),
ck2 AS (SELECT name, regexp_extract(name, 'checkpoint-(\\d+)', 1)::BIGINT AS step FROM ck)"""

SQL = {
    "chunk_rows": f"""WITH i AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_idx,
                         count(*) OVER () AS n FROM orders)
SELECT floor(row_idx / floor(n / {NUM_CHUNKS}))::BIGINT AS chunk_id, count(*) AS n_rows,
       min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM i GROUP BY 1""",
    "merge_groups": f"""WITH c AS (SELECT o_orderkey % {N_CHUNK_TABLES} + 1 AS chunk_id FROM orders)
SELECT floor((chunk_id - 1) / {MERGE_WIDTH})::BIGINT AS split_id, count(*) AS n_rows, count(DISTINCT chunk_id) AS n_chunks,
       min(chunk_id) AS first_chunk, max(chunk_id) AS last_chunk FROM c GROUP BY 1""",
    "dense_reindex": """SELECT name, dense_rank() OVER (ORDER BY name) - 1 AS subset_idx
FROM (SELECT DISTINCT 'subset_' || (p_size % 13) || '.' || (p_partkey % 3) AS name FROM part)""",
    "missing_shards": f"""WITH e AS (SELECT range AS shard_idx, {_sql_shard('range')} AS shard FROM range({SHARD_CATALOG['all']})),
p AS (SELECT DISTINCT {_sql_shard(f"o_custkey % {SHARD_CATALOG['all']}")} AS shard FROM orders)
SELECT shard, shard_idx FROM e WHERE shard NOT IN (SELECT shard FROM p)""",
    "retention": f"""WITH {_CK}
SELECT name, step FROM ck2 WHERE step < (SELECT min(step) FROM (SELECT step FROM ck2 ORDER BY step DESC LIMIT {KEEP_NEWEST}))
  AND (SELECT count(*) FROM ck2) >= {KEEP_NEWEST}""",
    "latest_snapshot": f"""WITH {_CK} SELECT arg_max(name, step) AS name, max(step) AS step FROM ck2""",
    "shard_plan": f"""WITH ja AS (SELECT p_partkey AS member, e.epoch FROM part, (SELECT range AS epoch FROM range({EPOCHS})) e),
en AS (SELECT c_custkey AS member, e.epoch FROM customer, (SELECT range AS epoch FROM range({EPOCHS})) e),
r AS (SELECT 'ja' AS side, epoch, member, row_number() OVER (PARTITION BY epoch ORDER BY md5(member || ':' || epoch || ':{SEED}'), member) - 1 AS pos,
             (SELECT count(*) FROM part) // {PLAN_GROUPS} AS size FROM ja
      UNION ALL
      SELECT 'en', epoch, member, row_number() OVER (PARTITION BY epoch ORDER BY md5(member || ':' || epoch || ':{SEED}'), member) - 1,
             (SELECT count(*) FROM customer) // {PLAN_GROUPS} FROM en)
SELECT side, epoch, (pos // size)::BIGINT AS slot, (pos % size)::BIGINT AS rank_in_slot, member FROM r WHERE pos // size < {PLAN_GROUPS}""",
    "seeded_shuffle": f"""SELECT e.epoch, row_number() OVER (PARTITION BY e.epoch ORDER BY md5(c_custkey || ':' || e.epoch || ':{SEED}'), c_custkey) - 1 AS position,
       c_custkey AS member FROM customer, (SELECT range AS epoch FROM range({EPOCHS})) e""",
    "resume_skip": f"""WITH s AS (SELECT row_number() OVER (ORDER BY md5(c_custkey || ':0:{SEED}'), c_custkey) - 1 AS position, c_custkey AS member FROM customer)
SELECT position, member, (position // {BATCH})::BIGINT AS batch_id FROM s WHERE position // {BATCH} >= {SKIP_BATCHES}""",
    "paired_batches": f"""WITH c AS (SELECT 'customer' AS side, row_number() OVER (ORDER BY md5(c_custkey || ':0:{SEED}'), c_custkey) - 1 AS r, c_custkey AS member FROM customer),
s AS (SELECT 'supplier' AS side, row_number() OVER (ORDER BY md5(s_suppkey || ':0:{SEED}'), s_suppkey) - 1 AS r, s_suppkey AS member FROM supplier),
u AS (SELECT side, (r // {BATCH // 2})::BIGINT AS batch_id, r % {BATCH // 2} AS pos_in_batch, member FROM c
      UNION ALL SELECT side, (r // {BATCH // 2})::BIGINT, r % {BATCH // 2}, member FROM s),
f AS (SELECT batch_id FROM u GROUP BY batch_id HAVING count(*) FILTER (WHERE side = 'customer') = {BATCH // 2}
                                               AND count(*) FILTER (WHERE side = 'supplier') = {BATCH // 2})
SELECT * FROM u WHERE batch_id IN (SELECT batch_id FROM f)""",
    "step_schedule": f"""SELECT n1, n2, (n1 // {BATCH * ACCUM})::BIGINT AS steps_per_epoch, (n1 // {BATCH * ACCUM})::BIGINT * {EPOCHS} AS total_steps,
       least(n1, n2) * 2 AS paired_rows
FROM (SELECT count(*) AS n1 FROM customer), (SELECT count(*) AS n2 FROM supplier)""",
}
