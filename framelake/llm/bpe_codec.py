"""BPE encoding by tree concatenation, and decoding."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import materialise, small_batches, table, text_or_empty

#: A text of more characters is halved until its parts have no more; all joins of parts are re-encoded windows.
LEAF_CHARS = 512
#: Tokens on either side of a join that the first window takes.
WINDOW = 6
#: Characters of a part that one task encodes by itself; parts of one text that one task joins at once.
PART_CHARS, PARTS_JOINED = 32_768, 64
PART_SCHEMA = "key bigint, run int, seq int, kind string, text string, ids binary, joins bigint"


def is_space(c: str) -> bool:
    """White space and controls, in a sense that is wider than any library's."""
    return c.isspace() or c < "!" or "\x7f" <= c <= "\xa0" or c in "\u180e\ufeff" or "\u200b" <= c <= "\u200f" or "\u2028" <= c <= "\u206f"


def window_start(left: list[int], codec: bpe.Codec, tokens: int) -> tuple[int, bytes]:
    """(i, bytes of left[i:]): where a window of about so many tokens may start.

    It starts at a whole character, and neither at an apostrophe nor one or two characters after one: there
    the split into words of the text from that place on is that of the whole text.
    """
    i = max(0, len(left) - tokens)
    while i:
        behind, data = codec.spell(left[max(0, i - 12) : i]), codec.spell(left[i:])
        if data[0] & 0xC0 != 0x80 and b"'" not in behind[-8:] and data[:1] != b"'":  # two characters have at most 8 bytes
            return i, data
        i = max(0, i - tokens)
    return 0, codec.spell(left)


def window_end(right: list[int], codec: bpe.Codec, tokens: int) -> tuple[int, bytes]:
    """(j, bytes of right[:j]): where it may end: at a whole character, after no white space and within no contraction."""
    j = min(len(right), tokens)
    while j < len(right):
        data, ahead = codec.spell(right[:j]), codec.spell(right[j : j + 1])
        if ahead[0] & 0xC0 != 0x80 and ahead[:1] != b"'" and b"'" not in data[-12:] and not is_space(data.decode()[-1]):
            return j, data
        j = min(len(right), j + tokens)
    return j, codec.spell(right)


def join_encodings(left: list[int], right: list[int], codec: bpe.Codec) -> list[int]:
    """Encoding of two texts' concatenation from their encodings.

    A window around the join is encoded anew and grows until its first token is the left side's token
    there and its last the right side's, or it has reached that side's end.  Then the result is exact: the split into words looks
    ahead only, so from a permitted start and up to a permitted end the window's words are the whole text's; and
    a sequence of tokens is a word's encoding if every two neighbours are, as merges depend on ranks alone.
    """
    if not left or not right:
        return left + right
    window = WINDOW
    while True:
        i, a = window_start(left, codec, window)
        j, b = window_end(right, codec, window)
        middle = codec.encode_plain((a + b).decode())
        if (i == 0 or middle[0] == left[i]) and (j == len(right) or middle[-1] == right[j - 1]):
            return left[:i] + middle + right[j:]
        window *= 2


def join_tree(parts: list[list[int]], codec: bpe.Codec) -> list[int]:
    while len(parts) > 1:
        parts = [join_encodings(parts[k], parts[k + 1], codec) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
    return parts[0] if parts else []


def halves(text: str, most: int) -> list[str]:
    if len(text) <= most:
        return [text]
    return halves(text[: len(text) // 2], most) + halves(text[len(text) // 2 :], most)


def encode_tree(text: str, codec: bpe.Codec, leaf: int = LEAF_CHARS) -> tuple[list[int], int]:
    """(ids, joins) of a text without special tokens' strings: its halves' halves encoded, then joined pair by pair."""
    parts = halves(text, leaf)
    return join_tree([codec.encode_plain(p) for p in parts], codec), len(parts) - 1


def stretches(text: str, codec: bpe.Codec) -> Iterator[tuple[str, list[int] | None]]:
    """A text cut at special tokens' strings: (text, None), or (string, its id)."""
    if not any(s in text for s in codec.specials):
        yield text, None
        return
    special = re.compile("|".join(f"({re.escape(s)})" for s in sorted(codec.specials, key=len, reverse=True)))
    for x in special.split(text):
        if x:
            yield x, [codec.specials[x]] if x in codec.specials else None


def encode_text(text: str, codec: bpe.Codec) -> tuple[list[int], int]:
    """(ids, joins) of a raw text.  Only vocabularies without a byte-level split are left to the library as a whole."""
    if codec.kind != "bytes":
        return codec.encode(text).tolist(), 0
    out, joins = [], 0
    for stretch, known in stretches(text, codec):
        ids, n = (known, 0) if known else encode_tree(stretch, codec)
        out, joins = out + ids if out else ids, joins + n
    return out, joins


def packed(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


def encode_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ids (binary, little-endian unsigned 32-bit), joins (of tree concatenation).

    Ids are those of ``tokenizers`` without added special tokens, truncation or padding; a special
    token's string inside a text is that token.  Every text over LEAF_CHARS is halved, whatever the halves cut through,
    encoded, and joined by windows.  Texts up to PART_CHARS are done in place, without a shuffle; longer ones are cut into
    parts that are spread over the cluster, encoded, joined PARTS_JOINED at a time by many tasks, and then to one.
    Null texts count as empty (no ids); null ids and repeated rows keep their rows; an empty table gives none; other columns are ignored.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text_or_empty(f"`{text_col}`").alias("text"))
    is_long = F.char_length("text") > PART_CHARS

    @F.pandas_udf("ids binary, joins bigint")
    def short(texts: pd.Series) -> pd.DataFrame:  # a row's own id stays out of pandas, which has no whole numbers beside nulls
        codec = bpe.codec(tokenizer_path)
        got = [encode_text(t, codec) for t in texts]
        return pd.DataFrame({"ids": [packed(x) for x, _ in got], "joins": [n for _, n in got]})

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = bpe.codec(tokenizer_path)
        for b in batches:
            for key, text in zip(b["key"], b["text"], strict=True):
                out = []
                for run, (stretch, known) in enumerate(stretches(text, codec) if codec.kind == "bytes" else [(text, None)]):
                    if known:
                        out.append((key, run, 0, "ids", None, packed(known), 0))
                    else:
                        out += [(key, run, k, "text", p, None, 0) for k, p in enumerate(halves(stretch, PART_CHARS) if codec.kind == "bytes" else [stretch])]
                yield pd.DataFrame(out, columns=[c.split()[0] for c in PART_SCHEMA.split(", ")])

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = bpe.codec(tokenizer_path)
        for b in batches:
            got = [(x, 0) if k == "ids" else (packed((y := encode_text(t, codec))[0]), y[1]) for k, t, x in zip(b["kind"], b["text"], b["ids"], strict=True)]
            yield b.assign(text=None, ids=[x for x, _ in got], joins=[n for _, n in got])

    def join(group: pd.DataFrame) -> pd.DataFrame:
        codec, out = bpe.codec(tokenizer_path), []
        for run, g in group.sort_values(["run", "seq"]).groupby("run", sort=True):
            ids = packed(join_tree([np.frombuffer(x, "<u4").tolist() for x in g["ids"]], codec)) if len(g) > 1 else g["ids"].iloc[0]
            out.append((group["key"].iloc[0], run, g["seq"].iloc[0] // PARTS_JOINED, "ids", None, ids, g["joins"].sum() + len(g) - 1))
        return pd.DataFrame(out, columns=[c.split()[0] for c in PART_SCHEMA.split(", ")])

    def whole(group: pd.DataFrame) -> pd.DataFrame:
        done = join(group)
        return pd.DataFrame({"key": [done["key"].iloc[0]], "ids": [b"".join(done["ids"])], "joins": [done["joins"].sum()]})

    done = rows.where(~is_long).select("id", short("text").alias("x")).select("id", "x.*")
    long = materialise(rows.where(is_long).withColumn("key", F.monotonically_increasing_id()), "long-texts")
    parts = long.select("key", "text").mapInPandas(cut, PART_SCHEMA).repartition("key", "run", "seq").mapInPandas(encode, PART_SCHEMA)
    joined = parts.groupBy("key", "run", F.floor(F.col("seq") / PARTS_JOINED)).applyInPandas(join, PART_SCHEMA)
    joined = joined.groupBy("key").applyInPandas(whole, "key bigint, ids binary, joins bigint")
    return done.unionByName(long.select("key", "id").join(joined, "key").select("id", "ids", "joins")).select(F.col("id").alias(id_col), "ids", "joins")


def decode_documents(encoded: DataFrame, tokenizer_path: str, id_col: str = "doc_id") -> DataFrame:
    """``encoded`` (id, ids and other columns) with text: decode(ids, skip_special_tokens=False).

    Null ids give the empty text; repeated rows keep their rows; an empty table gives none; a column ``text`` is replaced.
    """
    @F.pandas_udf("string")
    def decode(ids: pd.Series) -> pd.Series:
        codec = bpe.codec(tokenizer_path)
        return pd.Series([codec.decode(np.frombuffer(x or b"", "<u4")).decode() for x in ids], dtype="object")

    return encoded.select(*[F.col(f"`{c}`") for c in encoded.columns if c != "text"], decode("ids").alias("text"))


#: Texts that a Python worker holds at once.
BATCH = 200


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    with small_batches(spark, BATCH):  # a long text's ids are some hundred KB
        back = decode_documents(encode_documents(table(spark, sf_dir, "documents"), path), path)
        return materialise(digests(back), "round-trip")


def digests(back: DataFrame) -> DataFrame:
    return back.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"), "joins")
