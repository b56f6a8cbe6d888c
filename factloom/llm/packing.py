"""Texts into containers of fixed capacity: first-fit decreasing in randomised groups, over a tournament tree."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.bpe import BYTE_BPE_50K, count_tokens
from factloom.storage import cut

#: A group holds about so many full containers, or so many pieces if these are short.
GROUP_CONTAINERS, GROUP_PIECES = 2048, 20_000


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """Container of each size; sizes must not exceed capacity. Sizes must come in descending order.

    The tree's leaves are the free room of the containers, each inner node the larger of its two; so the first container
    with enough room is found, and changed, in as many steps as the tree has levels.
    """
    leaves = 1
    while leaves < max(1, len(sizes)):
        leaves *= 2
    room = [capacity] * (2 * leaves)
    out = []
    for s in sizes:
        k = 1
        while k < leaves:
            k *= 2
            if room[k] < s:
                k += 1
        out.append(k - leaves)
        room[k] -= s
        while k > 1:
            k //= 2
            room[k] = max(room[2 * k], room[2 * k + 1])
    return out


def pack(sizes: DataFrame, capacity: int = 2048, key: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """key, piece, n_tokens, container (long): where each piece of each row lies.

    A row of at most capacity is one piece, 0. A longer one is cut into full pieces and a rest. Rows of size 0 (or null)
    are one piece of size 0. Repeated keys are items of their own. An empty table gives no rows.
    Groups are drawn by a hash of the piece, their number from the totals, so each fits one task whatever the input.
    """
    pieces = cut(
        sizes.select(F.col(key), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("_n"))
        .withColumn("piece", F.explode(F.expr(f"sequence(0, greatest(ceil(_n / {capacity}) - 1, 0))")))
        .select(key, F.col("piece").cast("int").alias("piece"), F.least(F.lit(capacity), F.col("_n") - F.col("piece") * capacity).cast("long").alias("n_tokens"))
    )
    n, total = pieces.agg(F.count(F.lit(1)), F.sum("n_tokens")).first()
    groups = max(1, -(-(total or 0) // (capacity * GROUP_CONTAINERS)), -(-n // GROUP_PIECES))
    kind = sizes.schema[key].dataType.simpleString()

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", key, "piece"], ascending=[False, True, True], kind="stable")
        own = first_fit_decreasing(pdf["n_tokens"].tolist(), capacity)
        return pdf.assign(container=pdf["_g"].astype("int64") * (1 << 32) + own)[[key, "piece", "n_tokens", "container"]]

    grouped = pieces.withColumn("_g", F.pmod(F.xxhash64(key, "piece", F.lit(7)), F.lit(groups)))
    return grouped.groupBy("_g").applyInPandas(fill, f"`{key}` {kind}, piece int, n_tokens long, container long")


def pack_texts(docs: DataFrame, capacity: int = 2048, tokenizer: str = BYTE_BPE_50K) -> DataFrame:
    return pack(count_tokens(docs, tokenizer=tokenizer), capacity)


def containers(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """container, n_items, n_tokens, unused of each container."""
    return packed.groupBy("container").agg(F.count(F.lit(1)).alias("n_items"), F.sum("n_tokens").alias("n_tokens")).withColumn("unused", F.lit(capacity) - F.col("n_tokens"))
