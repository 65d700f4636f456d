"""Byte-pair encoding by a table of distinct words, and decoding by a join of ids with pieces.

Texts are normalised and split into words by the tokenizer's own rules, in blocks of bounded size.  A block keeps its
distinct words once and its texts as places in that list.  All blocks' words are dealt to parts by their hash, a row a block
and part, so each distinct one is encoded once, and its ids go back to the blocks by place; a word counts once a block, so a
frequent word is no hot key.  Ids are decoded by joining them with the table of pieces, which is as large as the vocabulary:
for whole texts within each block's task, each distinct word once, for any other table of ids by decode().

Null and empty texts have no ids and decode to the empty text.  Repeated rows get equal results; an empty table gives none;
other columns take no part, whatever their names.  Special tokens' strings in a text get their ids, as the library does by
default.  A text is in one block, whole, whatever its length.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from tokenizers import Tokenizer

from terrane.llm.common import two, written

#: Bytes of text in one block; a longer text is a block by itself.
BLOCK_BYTES = 24_000_000


@cache
def tokenizer(path: str) -> Tokenizer:
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@cache
def specials(path: str) -> dict[str, int]:
    return {t.content: i for i, t in tokenizer(path).get_added_tokens_decoder().items()}


@cache
def _steps(path: str):
    """The library's normaliser, splitter and model, bound once."""
    t = tokenizer(path)
    return t.normalizer.normalize_str if t.normalizer else str, t.pre_tokenizer.pre_tokenize_str, t.model.tokenize


def split_words(path: str, text: str) -> list[str]:
    """The words of a text as the model sees them; special tokens stand alone."""
    normal, split, _ = _steps(path)
    special = specials(path)
    parts = re.split("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")", text) if special else [text]
    words = []
    for part in parts:
        if part in special:
            words.append(part)
        elif part:
            words += [w for w, _ in split(normal(part))]
    return words


def encode_word(path: str, word: str) -> list[int]:
    special = specials(path).get(word)
    return [special] if special is not None else [x.id for x in _steps(path)[2](word)]


def _pack(x: np.ndarray) -> bytes:
    """Numbers with their first bytes together, then their second ones, and so on, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _unpack(b: bytes) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(flat.reshape(4, -1).T).view("<u4").ravel()


BLOCK = "block long, part int, doc_id array<long>, n array<int>, at binary, parts binary, words binary, sizes binary"
_BLOCK = ["block", "part", "doc_id", "n", "at", "parts", "words", "sizes"]
_KINDS = pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), *[pa.binary()] * 4


def word_blocks(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, parts: int = 8) -> DataFrame:
    """Rows of BLOCK; written.  A block's texts (part -1): doc_id, n (words of each), at (each word's place among the distinct
    ones, by falling frequency) and parts (which part each distinct one is dealt to).  Its distinct words, a row a part: words
    (compressed, in order of their places) and sizes in bytes.  Equal words are dealt to equal parts."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        table, seen, ids, counts, at, size = {}, {}, [], [], [], 0
        flat_of, length_of = array("I"), array("I")  # places of each unit's words, and how many it has

        def places(words: list[str]) -> list[int]:
            return [table.setdefault(w, len(table)) for w in words]

        def unit(u: str) -> int:
            mine = places(unit_words(path, u))
            flat_of.extend(mine)
            length_of.append(len(mine))
            return seen.setdefault(u, len(seen))

        def out():
            nonlocal number, table, seen, ids, counts, at, size, flat_of, length_of
            flat = np.concatenate([*at, np.zeros(0, np.uint32)])
            order = np.argsort(-np.bincount(flat, minlength=len(table)), kind="stable")
            rank = np.empty_like(order)
            rank[order] = np.arange(order.size)
            words = list(table)
            words = [words[i].encode() for i in order.tolist()]
            part = np.array([zlib.crc32(w) % parts for w in words], np.uint32)
            rows = [(number, -1, ids, counts, _pack(rank[flat]), _pack(part), None, None)]
            for k in np.unique(part).tolist():
                mine = [words[i] for i in np.flatnonzero(part == k).tolist()]
                rows.append((number, k, None, None, None, None, zstandard.ZstdCompressor(level=3).compress(b"".join(mine)), _pack(np.array([len(w) for w in mine]))))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _KINDS, strict=True)], _BLOCK)
            number, table, seen, ids, counts, at, size = number + 1, {}, {}, [], [], [], 0
            flat_of, length_of = array("I"), array("I")

        for batch in batches:
            docs, first = batch.column("doc_id").to_pylist(), 0
            for group in arrow_groups(batch.column("text"), min(block_bytes, 8_000_000)):
                apart = by_units(path)
                units, n, whole = split_units(path, group) if apart else (None, None, np.ones(len(group), bool))
                if apart:
                    named = units.dictionary.to_pylist()
                    which = np.array([k if (k := seen.get(u)) is not None else unit(u) for u in named], np.int64)
                    length, where = np.array(length_of, np.int64), which[units.indices.to_numpy()]
                    flat = gathered(np.array(flat_of, np.uint32), length, where)
                    end = np.concatenate([[0], np.cumsum(length[where])])[np.cumsum(n)].tolist()
                for i in range(len(group)):
                    at.append(np.array(places(split_words(path, group[i].as_py())), np.uint32) if whole[i] else flat[end[i - 1] if i else 0 : end[i]])
                    counts.append(at[-1].size)
                ids += docs[first : first + len(group)]
                first += len(group)
                size += group.nbytes
                if size >= block_bytes:
                    yield from out()
        if ids:
            yield from out()

    return written(two(df, id_col, text_col).mapInArrow(split, BLOCK), "bpe-blocks")


def encode_words(words: DataFrame, path: str) -> DataFrame:
    """block, part, ids, n (both packed): the ids of a block's words of one part, one word after another, and how many each has.

    words: block, part, words, sizes.  A part's rows meet in one task, which encodes each distinct word once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, now = Remembered(path), None
        for batch in batches:
            for row in batch.to_pylist():
                if row["part"] != now:
                    known, now = Remembered(path), row["part"]
                data, end = zstandard.ZstdDecompressor().decompress(row["words"]), np.cumsum(_unpack(row["sizes"])).tolist()
                each = [known.word(data[a:b].decode()) for a, b in zip([0, *end[:-1]], end, strict=True)]
                if len(known.words) > REMEMBERED:
                    known.words.clear()
                cells = row["block"], now, _pack(np.frombuffer(b"".join(each), "<u4")), _pack(np.array([len(x) >> 2 for x in each]))
                yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["block", "part", "ids", "n"])

    return words.repartition("part").sortWithinPartitions("part").mapInArrow(run, "block long, part int, ids binary, n binary")


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """id, piece: as many rows as the vocabulary has, so it may be broadcast."""
    return spark.createDataFrame([(i, p) for p, i in tokenizer(path).get_vocab(with_added_tokens=True).items()], "id int, piece string")


def decode(df: DataFrame, path: str, key: str, ids_col: str = "ids", glue: str = " ") -> DataFrame:
    """key, text: the pieces of the ids, joined.  For tokenizers without a decoder the library joins pieces by a space."""
    each = df.select(F.col(key), F.posexplode_outer(ids_col).alias("pos", "id"))
    named = each.join(F.broadcast(pieces(df.sparkSession, path)), "id", "left")
    order = F.sort_array(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("pos", "piece"))))
    return named.groupBy(key).agg(F.array_join(F.transform(order, lambda x: x["piece"]), glue).alias("text"))


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, ids, text (decoded) of every row; with digest: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = word_blocks(df, path, id_col, text_col, block_bytes, parts)
    coded = written(encode_words(blocks.where("part >= 0").select("block", "part", "words", "sizes"), path), "bpe-words")
    back = coded.groupBy("block").agg(F.collect_list(F.struct("part", "ids", "n")).alias("coded"))
    whole = blocks.where("part < 0").select("block", "doc_id", F.col("n").alias("n_words"), "at", "parts").join(back, "block", "left")
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "doc_id long, ids array<int>, text string"

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = tokenizer(path).get_vocab(with_added_tokens=True)
        piece = np.full(max(vocabulary.values()) + 1, "", object)
        piece[list(vocabulary.values())] = list(vocabulary)
        piece = pa.array(piece, pa.string())
        for batch in batches:
            for row in range(batch.num_rows):
                block = {n: batch.column(n)[row].as_py() for n in batch.schema.names}
                coded = sorted(block["coded"] or (), key=lambda c: c["part"])
                flat = np.concatenate([*(_unpack(c["ids"]) for c in coded), np.zeros(0, "<u4")])
                length = np.concatenate([*(_unpack(c["n"]) for c in coded), np.zeros(0, np.uint32)]).astype(np.int64)
                # Words by place, from words by part: a stable order by part keeps places in order within one.
                order = np.argsort(_unpack(block["parts"]), kind="stable")
                back = np.empty_like(order)
                back[order] = np.arange(order.size)
                flat, length = gathered(flat, length, back).astype("<u4"), length[back]
                words = pc.binary_join(_lists(np.cumsum(length), piece.take(pa.array(flat))), " ")
                at, done, rows, start = _unpack(block["at"]), 0, [], np.cumsum(length) - length
                for doc, n in zip(block["doc_id"], block["n_words"], strict=True):
                    mine = at[done : done + n]
                    done += n
                    ids = gathered(flat, length, mine, start).astype("<u4")
                    text = pc.binary_join(_lists(np.array([n]), words.take(pa.array(mine))), " ")[0].as_py()
                    if digest:
                        rows.append((doc, ids.size, hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
                    else:
                        rows.append((doc, ids.astype(np.int32), text))
                columns = list(zip(*rows, strict=True))
                if digest:
                    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
                    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                else:
                    kinds, names = (pa.int64(), pa.list_(pa.int32()), pa.string()), ["doc_id", "ids", "text"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return whole.mapInArrow(assemble, schema)


def _lists(end: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], end]), pa.int32()), values)


#: Code points that the tokenizers' \\s matches: Unicode's White_Space.
_SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: A run of other characters with the one space before it, or a run of spaces less what goes with the next run.
_SPACED = re.compile(f" ?[^{_SPACES}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+")
#: The pattern by which byte-level splitting splits (a fixed value).
_BYTE_LEVEL = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_APART = re.compile(r"[^\t-\r ]+")
#: Distinct units and words that a task remembers at once, and the longest that it remembers.
REMEMBERED, LONGEST = 600_000, 64


@cache
def unit_pattern(path: str) -> re.Pattern | None:
    """Cuts a text into units whose ids, one after another, are the text's ids; None: no such pattern is known.

    Byte-level splitting without a normaliser never joins what _SPACED parts.  A splitter that keeps only matches of a
    pattern without white space, after normalisers that don't look across a space, never joins what _APART parts.
    """
    t = json.loads(tokenizer(path).to_str())
    normal, split = t["normalizer"], t["pre_tokenizer"] or {}
    if normal is None and split.get("type") == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"]:
        return _SPACED
    steps = (normal or {}).get("normalizers", [normal] if normal else [])
    parts = split.get("pretokenizers", [split])
    local = all(n["type"] in ("NFC", "Lowercase") or n["type"] == "Replace" and (n["pattern"], n["content"]) == ({"Regex": "\\s+"}, " ") for n in steps)
    rest = all(q["type"] == "ByteLevel" and not q["use_regex"] and not q["add_prefix_space"] for q in parts[1:])
    if local and rest and parts[0].get("type") == "Split" and parts[0]["invert"] and parts[0]["behavior"] == "Removed":
        pattern = parts[0]["pattern"].get("Regex", " ").replace("[^\\s", "")
        return None if " " in pattern or "\\s" in pattern else _APART
    return None


def by_units(path: str) -> bool:
    """Whether texts are cut into units; asked here, as a task's own function may hold a copy of the pattern."""
    return unit_pattern(path) is _APART


#: How a splitter of letters, single digits and other runs is written (a fixed value), and what it parts where no
#: apostrophe, no control or other white space and nothing beyond Latin-1 occurs; there lower case is one to one as well.
_LETTERS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_LATIN = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
_PARTS = re.compile(f"[{_LATIN}]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^{_LATIN}0-9\xb2\xb3\xb9\xbc-\xbe]+")
_STRANGE = re.compile("[^!-&(-~\xa1-\xac\xae-\xff]")
_SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
#: How byte-level vocabularies spell a byte: itself, or for bytes that can't be shown what follows 255.
_SPELT = {b: chr(b) for b in _SHOWN} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(_SHOWN)))}


@cache
def _plain(path: str) -> bool:
    """Whether the words of plain units can be told without asking the library."""
    t = json.loads(tokenizer(path).to_str())
    if unit_pattern(path) is not _APART:
        return False
    kinds = [n["type"] for n in (t["normalizer"] or {}).get("normalizers", [])]
    parts = t["pre_tokenizer"].get("pretokenizers", [t["pre_tokenizer"]])
    return "Lowercase" in kinds and parts[0]["pattern"].get("Regex") == _LETTERS and len(parts) == 2


def unit_words(path: str, u: str) -> list[str]:
    """The words of a unit, by the library's normaliser and splitter where they aren't plain."""
    if _plain(path):
        if u.isascii() and u.isalpha():
            return [u.lower()]
        if not _STRANGE.search(u):
            words = _PARTS.findall(u.lower())
            return words if u.isascii() else [w if w.isascii() else w.encode().decode("latin-1").translate(_SPELT) for w in words]
    normal, split, _ = _steps(path)
    return [w for w, _ in split(normal(u))]


class Remembered:
    """What a task knows of units and words; forgotten when there are too many.  Long ones aren't kept."""

    def __init__(self, path: str):
        self.path, self.words, self.units = path, {}, {}

    def word(self, w: str) -> bytes:
        ids = self.words.get(w)
        if ids is None:
            ids = array("I", encode_word(self.path, w)).tobytes()
            if len(w) <= LONGEST:
                self.words[w] = ids
        return ids

    def ids(self, new: list[str]) -> list[bytes]:
        """Ids (little-endian unsigned 32-bit) of each unit."""
        if len(self.units) > REMEMBERED:
            self.units.clear()
        if len(self.words) > REMEMBERED:
            self.words.clear()
        out = []
        for u in new:
            ids = self.units.get(u)
            if ids is None:
                words = unit_words(self.path, u)
                ids = self.word(words[0]) if len(words) == 1 else b"".join([self.word(w) for w in words])
                if len(u) <= LONGEST:
                    self.units[u] = ids
            out.append(ids)
        return out


def gathered(flat: np.ndarray, length: np.ndarray, at: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """The pieces at[0], at[1], ... of flat one after another; length, start: each piece's."""
    start, size = np.cumsum(length) - length if start is None else start, length[at]
    return flat[np.repeat(start[at] - (np.cumsum(size) - size), size) + np.arange(size.sum())]


def arrow_groups(texts: pa.Array, most: int) -> Iterator[pa.Array]:
    """Runs of texts of about `most` bytes; a longer one is a run by itself."""
    edge, first, size = pc.fill_null(pc.binary_length(texts), 0).to_pylist(), 0, 0
    for i, n in enumerate(edge):
        if size and size + n > most:
            yield texts.slice(first, i - first)
            first, size = i, 0
        size += n + 1
    if size:
        yield texts.slice(first)


def split_units(path: str, texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """(units, how many each text has, which texts have to be taken whole, for which there are none).

    Those are texts with special tokens' strings, which end words on both sides.
    """
    whole = np.zeros(len(texts), bool)
    for s in specials(path):
        whole |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
    if whole.any():
        texts = pc.if_else(pa.array(whole), pa.scalar("", texts.type), texts)
    if _plain(path):
        # Letters in lower case, and a space where words end anyway, so there are fewer units.
        texts = pc.replace_substring_regex(pc.ascii_lower(texts), "([a-z0-9])([.,;:!?])", "\\1 \\2")
    lists = pc.ascii_split_whitespace(texts)
    return lists.flatten().dictionary_encode(), lists.value_lengths().to_numpy(), whole


@cache
def ranked(path: str) -> tiktoken.Encoding | None:
    """The same byte-level tokenizer by ranks, about four times as fast; None where ids don't count up with the merges."""
    t = json.loads(tokenizer(path).to_str())
    if unit_pattern(path) is not _SPACED:
        return None
    spelt = {c: b for b, c in _SPELT.items()}
    special, vocab = specials(path), t["model"]["vocab"]
    merges = [m if isinstance(m, list) else m.split(" ") for m in t["model"]["merges"]]
    if any(vocab[a + b] != 256 + i for i, (a, b) in enumerate(merges)):
        return None
    ranks = {bytes(spelt[c] for c in w): i for w, i in vocab.items() if w not in special}
    return tiktoken.Encoding("ranked", pat_str=_BYTE_LEVEL, mergeable_ranks=ranks, special_tokens=special)


#: So much white space in a row is more than the ranks' pattern can take.
_WHITE_RUN = re.compile(r"\s{50000}")


def library_ids(path: str, texts: list[str] | pa.Array, most: int = 8_000_000) -> Iterator[np.ndarray]:
    """Ids of each text as the library gives them, a bounded number of bytes at a time.

    Byte-level vocabularies go by ranks where that gives the same ids.  Otherwise texts are cut into units; the library's
    model encodes each distinct word once a task, as long as it is remembered.  Texts of any length and content are taken
    whole; null ones have no ids.
    """
    texts = pc.fill_null(pa.array(texts, pa.string()) if isinstance(texts, list) else texts, "")
    if fast := ranked(path):
        for x in texts:
            text = x.as_py()
            odd = len(text) > 50000 and _WHITE_RUN.search(text)
            yield np.array(tokenizer(path).encode(text, add_special_tokens=False).ids if odd else fast.encode(text, allowed_special="all"), "<u4")
        return
    if unit_pattern(path) is not _APART:
        for x in texts:
            yield np.array(tokenizer(path).encode(x.as_py(), add_special_tokens=False).ids, "<u4")
        return
    known = Remembered(path)
    for group in arrow_groups(texts, most):
        units, n, whole = split_units(path, group)
        each = known.ids(units.dictionary.to_pylist())
        length, at = np.array([len(x) >> 2 for x in each], np.int64), units.indices.to_numpy()
        flat = gathered(np.frombuffer(b"".join(each), "<u4"), length, at)
        end = np.concatenate([[0], np.cumsum(length[at])])[np.cumsum(n)] if at.size else np.zeros(len(n), np.int64)
        for i, (a, b) in enumerate(zip([0, *end[:-1].tolist()], end.tolist(), strict=True)):
            yield np.array(tokenizer(path).encode(group[i].as_py(), add_special_tokens=False).ids, "<u4") if whole[i] else flat[a:b]
