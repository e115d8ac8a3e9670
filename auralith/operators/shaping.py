"""Small table-shape helpers: row slices (P5/O6), schema assertion (P8), multi-column specs (P9/P9b), tag and
blank columns (P10), catalog/member predicates (F10/F11), batch ids (W4), step limits (O7/A5), waveform prefix
(O9) and nested subset catalogs (S4b/U3)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_slice(df: DataFrame, start: int, end: int, row_idx: str = "row_idx") -> DataFrame:
    """``select(range(start, end))`` on the persisted row index (a filter, so it prunes like any other)."""
    return df.where((F.col(row_idx) >= start) & (F.col(row_idx) < end))


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Fail early, on the driver, when a required column is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; found {df.columns}")
    return df


def column_specs(columns: str, *others: str) -> list[tuple[str, ...]]:
    """Comma lists zipped position by position (``column,task,language``); the shortest list wins."""
    lists = [x.split(",") for x in (columns, *others)]
    return [tuple(v.strip() for v in t) for t in zip(*lists)]


def feature_specs(columns: str, languages: str, tasks: str, timestamps: str, kl: str) -> dict[str, dict]:
    """Equal-length lists required; ``"true"`` -> True; keyed by task (a repeated task: the last one wins)."""
    lists = [x.split(",") for x in (columns, languages, tasks, timestamps, kl)]
    if len({len(x) for x in lists}) != 1:
        raise ValueError("feature spec lists must have equal length")
    out: dict[str, dict] = {}
    for col, lang, task, ts, k in zip(*lists):
        out[task.strip()] = {"column": col.strip(), "language": lang.strip(), "timestamp": ts.strip() == "true",
                             "kl": k.strip() == "true"}
    return out


def apply_per_column(df: DataFrame, columns: list[str], fn: Callable[[Column], Column], prefix: str = "") -> DataFrame:
    """The same column transform applied to every listed column (``prefix`` keeps the source column)."""
    for c in columns:
        df = df.withColumn(f"{prefix}{c}", fn(F.col(f"`{c}`")))
    return df


def tag_and_blank(df: DataFrame, dataset: str, text: str = "text", is_test: bool = False) -> DataFrame:
    """P10: constant dataset tag; the text of a test split is blanked."""
    out = df.withColumn("dataset", F.lit(dataset))
    return out.withColumn(text, F.lit("")) if is_test else out


def catalog_filter(name: Column, contains: str | None = None, endswith: str | None = None,
                   not_contains: str | None = None) -> Column:
    """name predicates of the dataset catalog."""
    cond = F.lit(True)
    if contains is not None:
        cond = cond & name.contains(contains)
    if endswith is not None:
        cond = cond & name.endswith(endswith)
    if not_contains is not None:
        cond = cond & ~name.contains(not_contains)
    return cond


def member_kind(name: Column, clips_dir: str = "clips/") -> Column:
    """route archive members by suffix/prefix."""
    return (
        F.when(name.endswith(".flac"), F.lit("audio"))
        .when(name.endswith(".trans.txt"), F.lit("transcript"))
        .when(name.endswith(".sph"), F.lit("audio"))
        .when(name.endswith(".stm"), F.lit("segments"))
        .when(name.startswith(clips_dir), F.lit("clip"))
        .otherwise(F.lit("other"))
    )


def batch_ids(row_idx: Column, batch_size: int) -> Column:
    """``floor(row_idx / B)``."""
    return F.floor(row_idx / F.lit(batch_size)).cast("long")


def limit_steps(df: DataFrame, batch_id: str, max_steps: int) -> DataFrame:
    """Stop after ``max_steps`` batches (a filter on the batch id, not a row cap on a scan)."""
    return df.where(F.col(batch_id) < max_steps)


def waveform_prefix(samples: Column, n: int) -> Column:
    """``samples[:n]``."""
    return F.slice(samples, 1, n)


def expand_subsets(spark, subset_dirs: dict[str, list[str]], archives_per_dir: dict[str, int], subset: str,
                   name_format: str = "{prefix}_part_{i}.tar.gz") -> DataFrame:
    """A nested subset (``l`` = ``s`` + ``m_additional`` + ``l_additional``) expands to the union of its
    directories' archives; archive names follow ``name_format`` with the ``_additional`` suffix dropped."""
    dims = spark.createDataFrame([(d, archives_per_dir[d]) for d in subset_dirs[subset]], "dir string, n int")
    prefix = F.regexp_replace(F.split("dir", "_").getItem(0), "_additional$", "")
    head, tail = name_format.split("{prefix}")
    before_i, after_i = tail.split("{i}")
    return dims.select("dir", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"), prefix.alias("prefix")).select(
        F.lit(subset).alias("subset"), "dir",
        F.concat(F.lit(head), F.col("prefix"), F.lit(before_i), F.col("i").cast("string"), F.lit(after_i)).alias("archive"))


def keep_columns(df: DataFrame, keep: set[str] | list[str]) -> DataFrame:
    """U6 + P2: drop every column outside the keep set (the set difference is taken on the driver, on names only)."""
    return df.drop(*[c for c in df.columns if c not in set(keep)])


def lineage_name(base: str, wer_threshold: float | None = None, vectorized: bool = False, chunk: int | None = None) -> str:
    """Derived-table naming ``<base>.wer_<t>`` / ``.vectorized`` / ``_<chunk>``; used as the partition path."""
    name = base if chunk is None else f"{base}_{chunk}"
    if wer_threshold is not None:
        name += f".wer_{wer_threshold}"
    return name + (".vectorized" if vectorized else "")
