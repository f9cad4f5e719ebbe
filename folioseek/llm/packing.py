"""Packing documents into sequences: shortest-pack-first over the length histogram.

Every document is tokenised once, into a table. Whole sequences are cut from the front of long ones; what is left, shorter than a
sequence, is counted by length. The driver packs this histogram (as many rows as a sequence has tokens, at most)
longest first onto the pack with the most room, working with counts, never with documents. The emptiest packs
beyond the least possible number are then dissolved and their documents cut to fill the gaps of the others, so
that less than one sequence of padding is left. Patterns are joined back to documents by length and rank.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_small_batches, release_memory, written

MAX_TOKENS = 4096
END_ID = 2
SALTS = 256
CACHED_WORDS = 300_000

_known: dict[str, tuple[object, dict[bytes, bytes] | None, dict[str, bytes], str]] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: How a tokenizer file must normalise and cut for words to be encoded one by one (fixed values: the lower-casing word tokenizer's).
_BY_WORDS = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {
                "type": "Split",
                "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
                "behavior": "Removed",
                "invert": True,
            },
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


def _loaded(path: str):
    """(tokenizer, cache of words, ids of pieces, numpy type of its ids); without a cache where texts must be encoded whole."""
    if path not in _known:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        file = json.loads(tokenizer.to_str())
        by_words = all(file[k] == v for k, v in _BY_WORDS.items()) and all(t["content"].startswith(_MAY_BE_SPECIAL.decode()) for t in file["added_tokens"])
        kind = "<u2" if tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"
        _known[path] = tokenizer, {} if by_words and kind == "<u2" else None, _Pieces(tokenizer), kind
    return _known[path]


def id_type(path: str) -> str:
    """The numpy type in which ``encode_texts`` gives the ids of a tokenizer file: as narrow as its vocabulary allows."""
    return _loaded(path)[3]


#: Words that need no normalising but lower case: printable ASCII without the apostrophe, and Latin-1 letters.
_SIMPLE = re.compile(r"[!-&(-~À-ÖØ-öø-ÿ]+")
#: What the strings of special tokens begin with. These are matched as they stand, so that words with it are not lower-cased here.
_MAY_BE_SPECIAL = b"<|"
#: How the tokenizer cuts such words once they are in lower case.
_PIECES = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


def _byte_letters() -> dict[int, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, the rest from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: b if b in plain else next(others) for b in range(256)}


_LETTERS = _byte_letters()


#: Texts that need no normalising but lower case and white space: printable ASCII and Latin-1 letters, and how the tokenizer cuts them then.
_SIMPLE_TEXT = re.compile(r"[\t-\r -~À-ÖØ-öø-ÿ]*")
_TEXT_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")


class _Pieces(dict):
    """Ids of the pieces of simple texts; those of a new piece come from the model."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenize = tokenizer.model.tokenize

    def __missing__(self, piece: str) -> bytes:
        letters = piece if piece.isascii() else piece.encode().decode("latin-1").translate(_LETTERS)
        found = self[piece] = array("H", [t.id for t in self.tokenize(letters)]).tobytes()
        return found


def _learn(words: list[bytes], tokenizer, cache: dict[bytes, bytes]) -> None:
    """Put the ids of new words into the cache; pieces of simple words go to the model directly."""
    pieces: dict[str, bytes] = {}
    tokenize, rest = tokenizer.model.tokenize, []
    for w in words:
        text = w.decode()
        if _MAY_BE_SPECIAL in w or not _SIMPLE.fullmatch(text):
            rest.append(w)
            continue
        ids = []
        for piece in _PIECES.findall(text.lower()):
            found = pieces.get(piece)
            if found is None:
                known = cache.get(raw := piece.encode())
                letters = piece if piece.isascii() else raw.decode("latin-1").translate(_LETTERS)
                found = pieces[piece] = cache[raw] = known or array("H", [t.id for t in tokenize(letters)]).tobytes()
            ids.append(found)
        cache[w] = b"".join(ids)
    for at in range(0, len(rest), 20_000):
        part = rest[at : at + 20_000]
        encoded = tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)
        cache.update((w, array("H", e.ids).tobytes()) for w, e in zip(part, encoded, strict=True))


def encode_texts(texts: list[bytes], path: str) -> list[bytes]:
    """Ids of each text as little-endian numbers of ``id_type``.

    A tokenizer that drops white space and lower-cases, so that no token crosses white space, has for a text the ids of its
    words one after another; words that occurred are kept in a bounded cache. Simple texts are cut into pieces as the tokenizer does it, without a look at
    their words. With any other file texts are encoded whole.
    """
    tokenizer, cache, pieces, kind = _loaded(path)
    if cache is None:
        out = []
        for at in range(0, len(texts), 16):
            encoded = tokenizer.encode_batch_fast([t.decode() for t in texts[at : at + 16]], add_special_tokens=False)
            out += [np.array(e.ids, kind).tobytes() for e in encoded]
        return out
    if len(pieces) > CACHED_WORDS:
        pieces.clear()
    out, others, ids = [], [], pieces.__getitem__
    for k, raw in enumerate(texts):
        if _MAY_BE_SPECIAL not in raw and _SIMPLE_TEXT.fullmatch(text := raw.decode()):
            out.append(b"".join(map(ids, _TEXT_PIECES.findall(text.lower()))))
        else:
            out.append(b"")
            others.append(k)
    split = [t.lower().split() if _MAY_BE_SPECIAL not in t else [w if _MAY_BE_SPECIAL in w else w.lower() for w in t.split()] for t in (texts[k] for k in others)]
    new = list(set(chain.from_iterable(split)).difference(cache))
    if len(cache) + len(new) > CACHED_WORDS:
        cache.clear()
        new = list(set(chain.from_iterable(split)))
    _learn(new, tokenizer, cache)
    for k, words in zip(others, split, strict=True):
        out[k] = b"".join(map(cache.__getitem__, words))
    return out


def tokenized(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, text) -> row_id, doc_id, n_tokens, ids: written, so that row_id stays the same."""
    kind = id_type(tokenizer)
    end = np.array([END_ID], kind).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                ids = [x + end for x in encode_texts([(t or "").encode() for t in part.column(1).to_pylist()], tokenizer)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(x) // len(end) for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"]
                )
        batch = part = ids = None
        release_memory()

    made = in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary")
    return written(made.withColumn("row_id", F.monotonically_increasing_id()), "tokens")


def plan_packs(histogram: dict[int, int], room: int = MAX_TOKENS) -> tuple[list[tuple[int, ...]], int]:
    """{length: count}, lengths below ``room`` -> (placements, number of sequences).

    A placement (length, rank, n, start, piece, sequence, offset) says that of documents of this length those from
    ``rank`` to ``rank + n`` put their ``piece`` tokens from ``start`` at ``offset`` of the sequences from
    ``sequence`` to ``sequence + n``.
    """
    # A group of equal packs: (-room left, first sequence, n, chain); a chain is (chain before, length, rank - sequence).
    packs: list[tuple[int, int, int, tuple | None]] = []
    opened = 0
    for length in sorted((k for k, n in histogram.items() if k and n), reverse=True):
        rank, left = 0, histogram[length]
        while left:
            if packs and -packs[0][0] >= length:
                space, at, n, held = heapq.heappop(packs)
                if n > left:
                    heapq.heappush(packs, (space, at + left, n - left, held))
                    n = left
            else:
                space, at, n, held = -room, opened, left, None
                opened += n
            heapq.heappush(packs, (space + length, at, n, (held, length, rank - at)))
            rank, left = rank + n, left - n
    total = sum(k * n for k, n in histogram.items())
    surplus = opened - -(-total // room)

    out: list[tuple[int, ...]] = []
    loose: list[tuple[int, int, int, int, int]] = []  # (-tokens left, length, rank, n, start)
    gaps: list[tuple[int, int, int]] = []  # (-room left, sequence, n)
    base = 0
    for space, at, n, held in sorted(packs, key=lambda p: (p[0], p[1])):  # the emptiest first
        gone = min(n, surplus)
        surplus -= gone
        items = []
        while held:
            held, length, delta = held
            items.append((length, delta))
        if gone:
            for length, delta in items:
                heapq.heappush(loose, (-length, length, at + delta, gone, 0))
        if n > gone:
            offset = 0
            for length, delta in reversed(items):
                out.append((length, at + gone + delta, n - gone, 0, length, base, offset))
                offset += length
            if offset < room:
                heapq.heappush(gaps, (offset - room, base, n - gone))
            base += n - gone
    while loose:
        tokens, length, rank, m, start = heapq.heappop(loose)
        space, at, n = heapq.heappop(gaps)
        both, piece = min(m, n), min(-tokens, -space)
        out.append((length, rank, both, start, piece, at, room + space))
        if m > both:
            heapq.heappush(loose, (tokens, length, rank + both, m - both, start))
        if -tokens > piece:
            heapq.heappush(loose, (tokens + piece, length, rank, both, start + piece))
        if n > both:
            heapq.heappush(gaps, (space, at + both, n - both))
        if -space > piece:
            heapq.heappush(gaps, (space + piece, at, both))
    return out, base


def _counted_before(rows: DataFrame, group: list[str], amount: str) -> DataFrame:
    """Add _before: the sum of ``amount`` over the rows of the group that come earlier, by salt and row_id."""
    inside = Window.partitionBy(*group, "_salt").orderBy("row_id").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy(*group).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*group, "_salt").agg(F.sum(amount).alias("_sum"))
    starts = sums.withColumn("_start", F.coalesce(F.sum("_sum").over(over), F.lit(0))).drop("_sum")  # SALTS rows a group at most
    rows = rows.withColumn("_inside", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    return rows.join(starts, [*group, "_salt"]).withColumn("_before", F.col("_inside") + F.col("_start")).drop("_inside", "_start")


def pack(docs: DataFrame, tokenizer: str | None = None, room: int = MAX_TOKENS) -> DataFrame:
    """doc_id, text -> a row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each document's ids end with ``END_ID``; a null or empty text has that id alone. Rows with equal or null
    doc_ids are documents of their own. Texts of any length are cut into whole sequences and a rest; rests of equal length are
    interchangeable and placed in the order of a hash of their rows. The tokenizer is used as its file has it: the string of a special token in a
    text is that token. An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    tokens = tokenized(docs, tokenizer or default_tokenizer())
    slim = tokens.select(
        "row_id", F.pmod(F.xxhash64("row_id"), F.lit(SALTS)).cast("int").alias("_salt"),
        (F.col("n_tokens") % room).alias("_rest"), F.floor(F.col("n_tokens") / room).alias("_full"),
    )
    counted = slim.where("_rest > 0").groupBy("_rest").count().collect()  # ``room`` rows at most
    placements, n_packs = plan_packs({int(r["_rest"]): r["count"] for r in counted}, room)

    schema = "_rest long, _rank long, _n long, _start long, length long, _sequence long, offset long"
    plan = F.broadcast(spark.createDataFrame(placements, schema))  # its size follows the histogram, not the data
    ranked = _counted_before(slim.where("_rest > 0").withColumn("_one", F.lit(1)), ["_rest"], "_one")
    hit = (ranked["_rest"] == plan["_rest"]) & F.col("_before").between(F.col("_rank"), F.col("_rank") + F.col("_n") - 1)
    ends = ranked.join(plan, hit).select(
        "row_id", (F.col("_full") * room + F.col("_start")).alias("start"), "length",
        (F.col("_sequence") + F.col("_before") - F.col("_rank")).alias("sequence_id"), "offset",
    )
    long = _counted_before(slim.where("_full > 0"), [], "_full")
    fulls = long.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_full") - 1))).select(
        "row_id", (F.col("k") * room).alias("start"), F.lit(room).cast("long").alias("length"),
        (F.col("_before") + F.col("k") + n_packs).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )
    fields = ["start", "length", "sequence_id", "offset"]
    pieces = ends.unionByName(fulls).groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("pieces"))
    joined = tokens.join(pieces, "row_id").select("doc_id", "n_tokens", "ids", "pieces")
    return joined.mapInArrow(_cutter(id_type(tokenizer or default_tokenizer())), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def _cutter(kind: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, n, ids, pieces in zip(*(c for c in batch.columns), strict=True):
                doc_id, n = doc_id.as_py(), n.as_py()
                wide = np.frombuffer(ids.as_buffer(), kind).astype("<u4")
                for p in pieces.as_py():
                    a, k = p["start"], p["length"]
                    out.append((doc_id, a, k, zlib.crc32(wide[a : a + k]), n, p["sequence_id"], p["offset"]))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 7, names)

    return run
