"""Token-ID output compressed by Re-Pair grammars, one per shard.

Ids of documents in ascending key order fill shards of bounded size. In each, the pairs that
occur most are replaced by new symbols again and again; a shard's container holds the rules, the
length that every rule expands to, and the remaining sequence, so that any stretch of ids can be
decoded without the rest. Containers are rows of a Parquet table in the shared folder, which
Spark commits as a whole.
"""

from __future__ import annotations

import os
import struct
import sys
import zlib
from collections.abc import Iterator
from functools import cached_property
from itertools import repeat

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer, pre_tokenizers

from eventrail.llm.common import ships_with_tasks, table
from eventrail.session import scratch_path

ships_with_tasks(__name__)

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
#: Ids that close a shard (a longer document fills one alone), and how often a pair must occur.
SHARD_IDS = 1 << 20
FREQUENT = 8
#: Rounds in a row, each with another hash, that must shorten a shard by less than this share to end.
IDLE_ROUNDS = 3
LEAST_GAIN = 0.005
#: Words whose ids a worker remembers, and code points of texts that are encoded at once.
CACHE_WORDS = 800_000
BATCH_CHARS = 4_000_000

_HEAD = "<4sIQII"  # magic, documents, ids, rules, symbols
_MAGIC = b"RPG1"
_MARKS = b".,;:!?"
_DOTTED = "\u0130"  # its lower case is a letter and a mark
_HASH = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = 18


def _lowered(text: bytes) -> bytes:
    """The text with its words of ASCII lower-cased, unless they may hold an added token."""
    if b"<|" in text:
        return b" ".join(w.lower() if w.isascii() and b"<|" not in w else w for w in text.split())
    # Without marks that could join a letter of ASCII, its case matters nowhere.
    if b"\xcc" in text or b"\xcd" in text:
        return b" ".join(w.lower() if w.isascii() else w for w in text.split())
    return text.lower()


def _split(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words of all texts, which one each word is, and the number of words of each text."""
    listed = pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).cast(pa.large_string()))
    found = listed.flatten().cast(pa.large_binary()).dictionary_encode()
    words, of = found.dictionary.to_pylist(), found.indices.to_numpy()
    many = np.diff(listed.offsets.to_numpy())
    if b"" in words:  # around the white space at the ends of a text
        whole = of != words.index(b"")
        many = np.diff(np.append(0, np.cumsum(whole))[np.append(0, np.cumsum(many))])
        of = of[whole]
    return words, of, many


class WordEncoder:
    """Encodes whole texts, each distinct word once as long as it is remembered.

    The vocabulary's tokenizer lower-cases, drops white space and never joins what white space
    separates, so the ids of a text are those of its words in order. Words of ASCII are
    lowered first, which leaves fewer words and changes no ids: others stay as they are where a
    mark follows that a capital may compose with otherwise than its small letter, and so do
    words that could hold an added token, which is spelled in small letters.

    Ids of all words lie in one array; a word is a slot, that is a stretch of it. When too many are
    remembered, those that were used once since the last time go.
    """

    def __init__(self, vocabulary: str, cache_words: int = CACHE_WORDS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(vocabulary)
        # Small letters of ASCII are one match each word, and stay as they are.
        self.letters = Tokenizer.from_str(vocabulary)
        self.letters.normalizer, self.letters.pre_tokenizer = None, pre_tokenizers.WhitespaceSplit()
        self.ending: dict[str, bool] = {}
        spelled = self.tokenizer.get_vocab(with_added_tokens=True)
        self.closing = np.zeros(max(spelled.values()) + 1, bool)
        self.closing[[n for token, n in spelled.items() if token.endswith("</w>")]] = True
        self.cache_words = cache_words
        # Slot 0 is the end of a document.
        self.slots: dict[bytes, int] = {b"": 0}
        self.begins, self.sizes, self.uses = (np.array(x, np.int64) for x in ([0], [1], [2]))
        self.flat = np.array([END_ID], np.uint32)

    def _ends_in_letter(self, stem: bytes) -> bool:
        """Whether a mark after the stem begins a match of its own, by the tokenizer itself.

        What counts is the last character once normalized: some letters become a letter and a
        mark, which would form one match with the marks after it.
        """
        if 97 <= stem[-1] <= 122:
            return True
        last = stem.decode()
        if not last[-1].isalpha():
            return False
        last = self.tokenizer.normalizer.normalize_str(last)[-1]
        if last not in self.ending:
            apart = self.tokenizer.pre_tokenizer.pre_tokenize_str(last + ".")
            self.ending[last] = last.isalpha() and len(apart) == 2
        return self.ending[last]

    def _stretches(self, slots: np.ndarray) -> np.ndarray:
        """The ids of the slots, one after the other."""
        sizes = self.sizes[slots]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.begins[slots] - (ends - sizes), sizes) + np.arange(total)]

    def _remember(self, words: list[bytes], sizes: np.ndarray, ids: np.ndarray) -> None:
        """New slots for the words, whose ids follow one another."""
        first = len(self.begins)
        self.slots.update(zip(words, range(first, first + len(words)), strict=True))
        self.begins = np.concatenate([self.begins, len(self.flat) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.uses = np.concatenate([self.uses, np.zeros(len(words), np.int64)])
        self.flat = np.concatenate([self.flat, ids])

    def _forget(self) -> None:
        """Keep the words used twice or more; of too many, the half that is used most."""
        least = 2
        if (self.uses >= least).sum() > self.cache_words // 2:
            least = max(2, int(np.partition(self.uses, -(self.cache_words // 2))[-(self.cache_words // 2)]))
        keep = self.uses >= least
        keep[0] = True
        number = np.cumsum(keep) - 1
        left = np.flatnonzero(keep)
        self.flat = self._stretches(left)
        self.slots = {w: n for w, n in zip(self.slots, number.tolist(), strict=True) if keep[self.slots[w]]}
        self.sizes = self.sizes[left]
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.uses = np.zeros(len(left), np.int64)
        self.uses[0] = 2

    def _learn(self, words: set[bytes]) -> None:
        """Ids of new words. Marks at the end of a word are split off and shared by all words.

        A letter before one of these marks ends a match of the vocabulary's pattern, and a word
        of letters is one match, whose last id is the only one that closes a word. So words of
        letters are encoded together and told apart by closing ids; all others go alone.
        """
        marked, stems, marks, needed = [], [], [], set()
        for word in words:
            stem = word.rstrip(_MARKS)
            if stem is word or not stem or not self._ends_in_letter(stem):
                needed.add(word)
            else:
                marked.append(word)
                stems.append(stem)
                marks.append(word[len(stem) :])
        needed.update(stems, marks)
        known = self.slots
        small, plain, other = [], [], []
        for word in needed:
            if word in known:
                continue
            if word.isalpha() and word.islower():
                small.append(word)
            elif (text := word.decode()).isalpha() and _DOTTED not in text:
                plain.append(word)
            else:
                other.append(word)
        learnt, sizes, found = [], [], []
        for coder, listed in ((self.letters, small), (self.tokenizer, plain)):
            groups = [listed[at : at + 512] for at in range(0, len(listed), 512)]
            joined = coder.encode_batch_fast([b" ".join(g).decode() for g in groups], add_special_tokens=False)
            for group, encoding in zip(groups, joined, strict=True):
                ids = np.array(encoding.ids, np.uint32)
                ends = np.flatnonzero(self.closing[ids]) + 1
                if len(ends) == len(group):
                    learnt += group
                    sizes.append(np.diff(ends, prepend=0))
                    found.append(ids)
                else:
                    other += group
        alone = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode() for w in other], add_special_tokens=False)]
        sizes.append(np.array([len(ids) for ids in alone], np.int64))
        found.append(np.array([n for ids in alone for n in ids], np.uint32))
        self._remember(learnt + other, np.concatenate(sizes), np.concatenate(found))
        get = known.__getitem__
        both = np.array([list(map(get, stems)), list(map(get, marks))], np.int64).reshape(2, -1)
        self._remember(marked, self.sizes[both].sum(0), self._stretches(both.T.ravel()))
        self.uses[both.ravel()] += 1

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text, the end id last."""
        if len(self.slots) > self.cache_words:
            self._forget()
        words, of, many = _split([_lowered((t or "").encode("utf-8", "replace")) for t in texts])
        slots = np.fromiter(map(self.slots.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(slots < 0)
        if len(missing):
            new = [words[at] for at in missing.tolist()]
            self._learn(set(new))
            slots[missing] = np.fromiter(map(self.slots.__getitem__, new), np.int64, len(new))
        used = slots[of]
        self.uses += np.bincount(used, minlength=len(self.uses))
        ended = np.insert(used, np.cumsum(many), 0)
        ends = np.cumsum(self.sizes[ended])[np.cumsum(many + 1) - 1]
        return np.split(self._stretches(ended).astype("<u4", copy=False), ends[:-1]) if len(texts) else []


def encoder(vocabulary: str) -> WordEncoder:
    """The encoder of this worker process; tasks that follow one another share its words."""
    held = sys.__dict__.setdefault("_word_encoders", {})
    key = zlib.crc32(vocabulary.encode())
    if key not in held:
        held[key] = WordEncoder(vocabulary)
    return held[key]


def _frequent_pairs(symbols: np.ndarray, least: int, turn: int) -> tuple[np.ndarray, ...]:
    """(places, slots, counts by slot, pairs by slot) of pairs that occur often enough.

    Pairs are counted in hashed slots, one pair in each; a pair that loses its slot to another
    has its chance in a later round, when the hash is another one.
    """
    code = symbols[:-1].astype(np.uint64)
    code <<= np.uint64(32)
    code |= symbols[1:]
    slot = code * (_HASH + np.uint64(2 * turn))
    slot >>= np.uint64(64 - _SPREAD)
    slot = slot.view(np.int64)  # as indexes are, so that nothing converts them
    at = np.flatnonzero((np.bincount(slot, minlength=1 << _SPREAD) >= least).take(slot))
    code, slot = code.take(at), slot.take(at)
    pair = np.zeros(1 << _SPREAD, np.uint64)
    pair[slot] = code
    mine = pair.take(slot) == code
    at, slot = at[mine], slot[mine]
    counts = np.bincount(slot, minlength=1 << _SPREAD)
    often = counts.take(slot) >= least
    return at[often], slot[often], counts, pair


def compress(ids: np.ndarray, base: int, frequent: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Rules (left, right) of the symbols from ``base`` on, and the sequence that is left.

    A round replaces every frequent pair where it outnumbers the pairs that overlap it, so the
    most frequent pairs go first. It ends after ``IDLE_ROUNDS`` rounds that gain next to nothing.
    """
    symbols, rules = ids.astype(np.uint32), [np.zeros((0, 2), np.uint32)]
    made, turn, idle = base, 0, 0
    while len(symbols) > 1 and idle < IDLE_ROUNDS:
        before = len(symbols)
        fresh, symbols = _round(symbols, made, frequent, turn)
        rules.append(fresh)
        made += len(fresh)
        turn += 1
        idle = idle + 1 if before - len(symbols) <= LEAST_GAIN * before else 0
    return np.concatenate(rules), symbols


def _round(symbols: np.ndarray, made: int, frequent: int, turn: int) -> tuple[np.ndarray, np.ndarray]:
    """New rules, of the symbols from ``made`` on, and the sequence with them applied."""
    at, slot, counts, pair = _frequent_pairs(symbols, frequent, turn)
    weight = np.zeros(len(symbols) + 2, np.int64)
    own = 2 * counts.take(slot) + (at & 1)  # runs of one symbol: every second pair
    weight[at + 1] = own
    chosen = (own > weight.take(at)) & (own > weight.take(at + 2))
    at, slot = at[chosen], slot[chosen]
    worth = np.bincount(slot, minlength=len(counts)) * 2 >= frequent
    chosen = worth[slot]
    at, slot = at[chosen], slot[chosen]
    if not len(at):
        return np.zeros((0, 2), np.uint32), symbols
    fresh = pair[worth]
    symbols[at] = (made + np.cumsum(worth) - 1)[slot]
    rest = np.ones(len(symbols), bool)
    rest[at + 1] = False
    halves = [fresh >> np.uint64(32), fresh & np.uint64(0xFFFFFFFF)]
    return np.stack(halves, 1).astype(np.uint32), symbols[rest]


def expansion_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    lengths = [1] * len(rules)
    for n, (left, right) in enumerate(rules.tolist()):
        lengths[n] = (lengths[left - base] if left >= base else 1) + (
            lengths[right - base] if right >= base else 1
        )
    return np.array(lengths, np.uint32)


def _kind(symbols: int) -> str:
    """The narrowest number that holds every symbol."""
    return "<u2" if symbols <= 1 << 16 else "<u4"


def pack(keys: list[int | None], lengths: list[int], ids: np.ndarray, frequent: int = FREQUENT) -> bytes:
    """One container: keys and id counts of its documents, rules, expansion lengths, sequence."""
    base = int(ids.max()) + 1
    rules, symbols = compress(ids, base, frequent)
    null = np.array([k is None for k in keys], np.uint8)
    kind = _kind(base + len(rules))
    parts = [
        struct.pack(_HEAD, _MAGIC, len(keys), len(ids), len(rules), len(symbols)),
        struct.pack("<I", base),
        null.tobytes(),
        np.array([k or 0 for k in keys], "<i8").tobytes(),
        np.array(lengths, "<u8").tobytes(),
        rules.astype(kind).tobytes(),
        expansion_lengths(rules, base).astype("<u4").tobytes(),
        symbols.astype(kind).tobytes(),
    ]
    return b"".join(parts)


class Container:
    """Reads a container back, whole or any stretch of it."""

    def __init__(self, data: bytes) -> None:
        magic, docs, self.n_ids, rules, symbols = struct.unpack_from(_HEAD, data)
        if magic != _MAGIC:
            raise ValueError("not a grammar container")
        (self.base,) = struct.unpack_from("<I", data, struct.calcsize(_HEAD))
        at = struct.calcsize(_HEAD) + 4

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        null = take("u1", docs)
        self.keys = [None if n else k for n, k in zip(null.tolist(), take("<i8", docs).tolist(), strict=True)]
        self.lengths = take("<u8", docs).astype(np.int64)
        kind = _kind(self.base + rules)
        self.rules = take(kind, 2 * rules).reshape(-1, 2).astype(np.int64)
        self.expands = take("<u4", rules).astype(np.int64)
        self.symbols = take(kind, symbols).astype(np.uint32)
        self.ends = np.cumsum(self._widths(self.symbols))

    def _widths(self, symbols: np.ndarray) -> np.ndarray:
        widths = np.ones(len(symbols), np.int64)
        new = symbols >= self.base
        widths[new] = self.expands[symbols[new] - self.base]
        return widths

    @cached_property
    def _expansions(self) -> tuple[np.ndarray, np.ndarray]:
        """What every rule stands for, one after the other, and where each begins."""
        begins = np.append(0, np.cumsum(self.expands))
        table, base = np.empty(begins[-1], np.uint32), self.base
        for (left, right), at in zip(self.rules.tolist(), begins.tolist(), strict=False):
            for symbol in (left, right):
                if symbol < base:
                    table[at] = symbol
                    at += 1
                else:
                    low, high = begins[symbol - base], begins[symbol - base + 1]
                    table[at : at + high - low] = table[low:high]
                    at += high - low
        return table, begins

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        """The symbols with the expansions of the rules in place of theirs."""
        table, begins = self._expansions
        widths = self._widths(symbols)
        out = np.repeat(symbols, widths)
        new = np.flatnonzero(out >= self.base)
        ends = np.cumsum(widths)
        rule = out[new] - self.base
        first = np.repeat(ends - widths, widths)[new]
        out[new] = table[begins[rule] + new - first]
        return out

    def ids(self, start: int = 0, end: int | None = None) -> np.ndarray:
        """The ids from ``start`` to ``end``; only the symbols that cover them are expanded."""
        end = self.n_ids if end is None else end
        if start >= end:
            return np.zeros(0, np.uint32)
        first = int(np.searchsorted(self.ends, start, "right"))
        last = int(np.searchsorted(self.ends, end, "left"))
        before = int(self.ends[first - 1]) if first else 0
        found = self._expand(self.symbols[first : last + 1])
        return found[start - before : end - before]


def write(
    docs: DataFrame,
    path: str,
    vocabulary: str | None = None,
    key: str = "doc_id",
    shard_ids: int = SHARD_IDS,
    frequent: int = FREQUENT,
) -> None:
    """The ids of all texts, in ascending key order, as containers in a Parquet table.

    Columns: part (the range of keys), before (ids of the part in front of the container),
    n_ids, data. Null keys come first; a null or empty text has the end id only. Rows of one
    key follow one another in the order of a hash of their texts, so a key may fill many
    containers; an empty table gives an empty one.
    """
    if vocabulary is None:
        with open(public_tokenizers.path(VOCABULARY), encoding="utf-8") as file:
            vocabulary = file.read()
    # A vocabulary file is two megabytes whatever the corpus.
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def containers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder, part = encoder(shared.value), TaskContext.get().partitionId()
        keys: list[int | None] = []
        held: list[np.ndarray] = []
        before = size = 0

        def close() -> pd.DataFrame:
            nonlocal keys, held, before, size
            data = pack(keys, [len(x) for x in held], np.concatenate(held), frequent)
            row = pd.DataFrame({"part": [part], "before": [before], "n_ids": [size], "data": [data]})
            keys, held, before, size = [], [], before + size, 0
            return row

        for batch in batches:
            names = [None if pd.isna(k) else int(k) for k in batch["key"]]
            texts = batch["text"].tolist()
            chars = np.cumsum([len(t or "") for t in texts])
            cuts = np.unique(np.append(np.searchsorted(chars, np.arange(0, chars[-1:].sum(), BATCH_CHARS)), len(texts)))
            for lo, hi in zip([0, *cuts.tolist()], cuts.tolist(), strict=False):
                for name, ids in zip(names[lo:hi], coder.encode(texts[lo:hi]), strict=True):
                    if size and size + len(ids) > shard_ids:
                        yield close()
                    keys.append(name)
                    held.append(ids)
                    size += len(ids)
        if size:
            yield close()

    order = [F.col(key).alias("__order"), F.xxhash64("text").alias("__tie")]
    rows = docs.select(F.col(key).cast("string").alias("key"), "text", *order)
    dealt = rows.repartitionByRange("__order", "__tie").sortWithinPartitions("__order", "__tie").select("key", "text")
    dealt.mapInPandas(containers, "part int, before long, n_ids long, data binary").write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(key, start, n_tokens, ids_crc32) per document, from the containers."""
    files = spark.read.schema("part int, before long, n_ids long, data binary").parquet(path)
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range of keys, as many as the writing job had tasks.
    parts = (
        files.groupBy("part")
        .agg(F.sum("n_ids").alias("ids"))
        .select("part", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("first"))
    )

    def documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start, data in zip(batch["start"], batch["data"], strict=True):
                box = Container(data)
                ids, ends = box.ids().astype("<u4"), np.cumsum(box.lengths)
                crc = [zlib.crc32(ids[e - n : e]) for e, n in zip(ends, box.lengths, strict=True)]
                yield pd.DataFrame(
                    {
                        "doc_id": pd.array(box.keys, "Int64"),
                        "start": start + ends - box.lengths,
                        "n_tokens": box.lengths,
                        "ids_crc32": crc,
                    }
                )

    placed = files.join(F.broadcast(parts), "part").select(
        (F.col("first") + F.col("before")).alias("start"), "data"
    )
    return placed.mapInPandas(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written as grammar containers and read back."""
    path = scratch_path(spark, "repair")
    write(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return read(spark, path)
