"""Best-fit packing of token runs into sequences of several permitted lengths.

Texts are counted in tokens of a public tokenizer, each with one separator token after it. A text longer than the
largest permitted length is cut into full sequences and a rest. Pieces are dealt by hash to shards of bounded size and
each shard is packed by best-fit decreasing: a piece goes to the open bin that it leaves least room in. Where none fits,
a bin is opened: the permitted length with the least cost for each token that it can be expected to hold, given what
the shard still has to place. At the end every bin shrinks to the smallest permitted length that holds its contents.

The cost of a length is ``length * (1 + length / quadratic)`` plus ``overhead``: attention grows with the square.

Edge cases: null and empty texts have no tokens and form pieces of one separator, so they are not lost; a null id is packed
like others; equal sizes are placed by id and piece number; repeated rows are packed each; an empty table gives no bins.
Other columns, and their names, do not matter.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# fixed value: the split pattern of this public vocabulary
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LENGTHS = (512, 1024, 2048, 4096)
_ENCODERS: dict[str, tiktoken.Encoding] = {}


def load_ranks(path: str = TOKENIZER) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def token_counts(docs: DataFrame, path: str = TOKENIZER, text: str = "text", name: str = "n_tokens") -> DataFrame:
    """``docs`` with the token count of the whole text; the vocabulary (fixed size) travels with the job."""
    shared = docs.sparkSession.sparkContext.broadcast(load_ranks(path))

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if path not in _ENCODERS:
            _ENCODERS[path] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=shared.value, special_tokens={})
        encode = _ENCODERS[path].encode_ordinary
        for texts in batches:
            yield pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int64")

    return docs.withColumn(name, count(F.col(text)))


@dataclass(frozen=True)
class Costs:
    lengths: tuple[int, ...] = LENGTHS
    quadratic: float = 8192.0
    overhead: float = 16.0

    def of(self, length: int) -> float:
        return length * (1 + length / self.quadratic) + self.overhead


def pack(sizes: list[int], costs: Costs) -> tuple[list[int], list[int]]:
    """Bin of each piece, and the final length of each bin. ``sizes`` must be in falling order."""
    lengths = sorted(costs.lengths)
    largest = lengths[-1]
    rising = sizes[::-1]
    sums = [0]
    for s in rising:
        sums.append(sums[-1] + s)
    room: dict[int, list[int]] = {}                 # free tokens -> open bins
    free: list[int] = []                            # sorted keys of ``room``
    used: list[int] = []
    where: list[int] = []
    for i, size in enumerate(sizes):
        if size > largest:
            raise ValueError(f"a piece of {size} tokens is longer than {largest}")
        at = bisect_left(free, size)
        if at == len(free):                         # nothing fits: open the length that is cheapest for what it will hold
            left = len(sizes) - i - 1               # pieces still to come are the ``left`` smallest

            def per_token(length: int) -> float:
                gap = length - size
                waiting = sums[min(left, bisect_left(rising, gap + 1, 0, left))]
                return costs.of(length) / (size + min(gap, waiting))

            length = min((x for x in lengths if x >= size), key=lambda x: (per_token(x), x))
            b, gap = len(used), length
            used.append(0)
        else:
            gap = free[at]
            b = room[gap].pop()
            if not room[gap]:
                del room[gap], free[at]
        used[b] += size
        where.append(b)
        gap -= size
        if gap > 0:
            if gap not in room:
                room[gap] = []
                insort(free, gap)
            room[gap].append(b)
    return where, [lengths[bisect_left(lengths, u)] for u in used]


BINS = "bin_id string, bin_length int, used int, pieces array<struct<doc_id:long,piece:int,start:long,end:long>>"


def best_fit(docs: DataFrame, costs: Costs = Costs(), tokens: str = "n_tokens", shard_pieces: int = 20_000) -> DataFrame:
    """One row per bin: its length, used tokens, and pieces as token spans of documents.

    A piece's ``end`` counts the separator where it is the text's last piece. Shards are numbered by hash of id and piece;
    their count follows the number of pieces, so a task holds about ``shard_pieces`` whatever the table's size.
    """
    largest = max(costs.lengths)
    whole = docs.select("doc_id", (F.coalesce(F.col(tokens), F.lit(0)) + 1).alias("_n"))
    pieces = (whole.select("doc_id", "_n", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(largest).cast("long"))).alias("piece", "start"))
              .withColumn("end", F.least(F.col("start") + largest, F.col("_n"))).drop("_n"))
    # how many pieces there are follows from the lengths alone
    total = whole.agg(F.sum(F.ceil(F.col("_n") / largest))).first()[0] or 0
    shards = max(1, -(-int(total) // shard_pieces))
    dealt = pieces.withColumn("_shard", F.pmod(F.xxhash64(F.coalesce("doc_id", F.monotonically_increasing_id()), "piece", "end"), F.lit(shards)).cast("int"))

    def fill(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.assign(size=frame["end"] - frame["start"]).sort_values(["size", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        where, lengths = pack(frame["size"].tolist(), costs)
        held: list[list[dict]] = [[] for _ in lengths]
        used = [0] * len(lengths)
        ids = [None if pd.isna(d) else int(d) for d in frame["doc_id"]]
        for b, d, p, s, e in zip(where, ids, frame["piece"], frame["start"], frame["end"]):
            held[b].append({"doc_id": d, "piece": int(p), "start": int(s), "end": int(e)})
            used[b] += int(e - s)
        return pd.DataFrame({"bin_id": [f"{key[0]}-{i}" for i in range(len(lengths))], "bin_length": lengths, "used": used, "pieces": held})

    return dealt.groupBy("_shard").applyInPandas(fill, BINS)
