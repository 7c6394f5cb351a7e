"""Weighted rendezvous hashing of record keys over shards."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Shard name -> weight of the registered query; a shard of weight 2 gets twice the records of one of weight 1.
SHARDS: dict[str, float] = {f"shard-{i:02d}": 2.0 if i < 4 else 1.0 for i in range(16)}
#: Hex digits of the MD5 that give the uniform number: 13 digits are 52 bits, which a double holds exactly.
DIGITS = 13


def score(key: Column, shard: str, weight: float) -> Column:
    """-weight / ln(u) with u uniform in (0, 1) from the MD5 of key and shard; the shard with the highest score gets the record."""
    digest = F.substring(F.md5(F.concat(key.cast("string"), F.lit("|" + shard))), 1, DIGITS)
    u = (F.conv(digest, 16, 10).cast("double") + 0.5) / float(16**DIGITS)
    return F.lit(-float(weight)) / F.ln(u)


def shard_of(key: Column, shards: Mapping[str, float]) -> Column:
    """Name of the key's shard; null for a null key. Equal scores go to the greatest shard name.

    A shard that is added takes records only from the others' shares in proportion to its weight, and one that is removed
    gives up only its own, as no record's scores for the other shards change.
    """
    if not shards or any(w <= 0 for w in shards.values()):
        raise ValueError("shards need a name and a positive weight each")
    best = F.greatest(*(F.struct(score(key, s, w).alias("score"), F.lit(s).alias("shard")) for s, w in shards.items())) if len(shards) > 1 else F.struct(F.lit(next(iter(shards))).alias("shard"))
    return F.when(key.isNotNull(), best["shard"])


def assign_shards(df: DataFrame, key: str = "doc_id", shards: Mapping[str, float] = SHARDS, out: str = "shard") -> DataFrame:
    """df with its shard's name in column out (replaced where df has such a column).

    A row-wise projection inside code generation: no shuffle, and each row's shard depends on its own key alone. Repeated
    keys share a shard; a null key has the shard null; an empty table gives an empty one.
    """
    return df.withColumn(out, shard_of(F.col(f"`{key}`"), shards))


def write_shards(df: DataFrame, path: str, key: str = "doc_id", shards: Mapping[str, float] = SHARDS, files_per_shard: int = 8, out: str = "shard") -> None:
    """Write df as Parquet in a folder a shard. Rows spread over files_per_shard tasks of each shard by a hash of the key."""
    placed = assign_shards(df, key, shards, out)
    salt = F.pmod(F.xxhash64(F.col(f"`{key}`").cast("string")), F.lit(files_per_shard))
    placed.repartition(len(shards) * files_per_shard, F.col(f"`{out}`"), salt).write.partitionBy(out).parquet(path)


def oracle(name: str = "documents", key: str = "doc_id", shards: Mapping[str, float] = SHARDS) -> str:
    values = ", ".join(f"('{s}', {float(w)!r})" for s, w in shards.items())
    return f"""WITH shards(shard, weight) AS (VALUES {values}),
    scored AS (
      SELECT {key}, shard, -weight::DOUBLE / ln((('0x' || substr(md5({key}::VARCHAR || '|' || shard), 1, {DIGITS}))::BIGINT::DOUBLE + 0.5) / {float(16**DIGITS)!r}) AS score
      FROM {name} CROSS JOIN shards)
    SELECT {key}, arg_max(shard, score) AS shard FROM scored GROUP BY {key}"""
