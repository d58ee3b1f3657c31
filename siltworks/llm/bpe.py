"""BPE encoding and decoding with a minimal acyclic transducer as the lexicon of frequent words.

* Words are the pieces of the byte-level pattern; they are counted over the whole table, in stretches of each task first (a
  word that comes once in a stretch is none of the frequent), and the most frequent, up to ``lexicon``, are merged to ids once.
* These words become a minimal acyclic automaton over their bytes: equal suffixes are one set of states. Each arc carries the
  number of words that sort before, so a word's walk adds up to its rank, which finds its ids. The arrays are one
  file, which Spark hands to each executor and every Python worker there maps into memory.
* A word outside the lexicon is merged exactly, by the ranks of the vocabulary's merges.

Encoding is that of the tokenizer file's byte-level model without padding and truncation; added tokens are found in the text first
and decoding keeps them. Results in odd cases: a null text is empty; an empty text has no ids and decodes to itself. Rows that
repeat an id are encoded alike. An empty table gives no rows, an empty lexicon only merges. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import tempfile
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import regex
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.llm.common import cut

#: Fixed value: the pattern of byte-level pieces.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
STRETCH = 2_000_000  # characters that are encoded at once
CELLS = 500_000  # ids that are merged side by side
LONG = 256  # bytes of a word that is merged by itself


@dataclass(frozen=True)
class Params:
    lexicon: int = 50_000
    counted: int = 300_000  # distinct words that a task counts before it passes on their counts


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Lookup:
    """A hash table from non-negative 64-bit keys to 32-bit values, for whole arrays of keys at once; absent keys give -1."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[left[free]]  # of several, the last one stays
            mine = self.keys[at] == keys[left]
            self.values[at[mine]] = values[left[mine]]
            left, at = left[~mine], (at[~mine] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        seen = self.keys[at]
        out = np.where(seen == keys, self.values[at], -1)
        left = np.flatnonzero((seen != keys) & (seen >= 0))
        while len(left):
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            seen = self.keys[at[left]]
            hit = seen == keys[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (seen >= 0)]
        return out


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices of the runs that begin at ``starts``, one run after the other."""
    before = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) + np.repeat(starts - before, lengths)


class Vocabulary:
    """Ids, merges and added tokens of a byte-level BPE tokenizer file (its text)."""

    def __init__(self, text: str) -> None:
        spec = json.loads(text)
        if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec.get("normalizer"):
            raise ValueError("not a byte-level BPE tokenizer without a normalizer")
        letter = byte_letters()
        raw = lambda token: bytes(letter[c] for c in token)
        ids = {raw(k): v for k, v in spec["model"]["vocab"].items()}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.single = np.array([ids[bytes([b])] for b in range(256)], np.int32)
        pairs = [(ids[raw(a)] << 32 | ids[raw(b)], ids[raw(a) + raw(b)]) for a, b in merges]
        # a pair's rank is its place among the merges; what it becomes is the id at that place
        self.rank = Lookup(np.array([k for k, _ in pairs], np.int64), np.arange(len(pairs), dtype=np.int32))
        self.made = np.array([v for _, v in pairs], np.int32)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {v: k for k, v in ids.items()} | {v: k.encode() for k, v in self.added.items()}
        self.prefix = bool(spec["pre_tokenizer"].get("add_prefix_space"))
        longest = sorted(self.added, key=len, reverse=True)
        self.split = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None
        self.pieces = regex.compile(PATTERN).findall

    def parts(self, text: str) -> list[str]:
        """The text cut at added tokens, these at odd places."""
        return self.split.split(text) if self.split and any(x in text for x in self.added) else [text]

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(lengths, ids) of the words, one after the other: in each, the pair of the lowest rank merges first, the leftmost of equal ones.

        Words of like length are merged side by side, a row each, in as many rounds as the longest chain of merges takes;
        words of over ``LONG`` bytes each by a heap of its pairs.
        """
        size = np.fromiter(map(len, words), np.int64, len(words))
        raw, begins = np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size
        lengths, parts = np.zeros(len(words), np.int64), []
        order = np.argsort(size, kind="stable")
        at = 0
        while at < len(order):
            width = int(size[order[at]])
            if width > LONG:
                for k in order[at:].tolist():
                    ids = self._merge_long(words[k])
                    lengths[k] = len(ids)
                    parts.append((np.array([k]), ids))
                break
            width = max(8, 1 << (width - 1).bit_length()) if width > 1 else 1
            end = at + int(np.searchsorted(size[order[at:]], min(width, LONG), side="right"))
            end = min(end, at + max(1, CELLS // width))
            rows = order[at:end]
            ids = np.full((len(rows), width), -1, np.int32)
            column = np.arange(width)
            inside = column < size[rows, None]
            ids[inside] = self.single[raw[ragged(begins[rows], size[rows])]]
            self._merge_rows(ids)
            there = ids >= 0
            lengths[rows] = there.sum(axis=1)
            parts.append((rows, ids[there]))
            at = end
        starts, out = np.cumsum(lengths) - lengths, np.empty(int(lengths.sum()), np.int32)
        for rows, ids in parts:
            out[ragged(starts[rows], lengths[rows])] = ids
        return lengths, out

    def _merge_long(self, word: bytes) -> np.ndarray:
        if not hasattr(self, "pair"):
            here = np.flatnonzero(self.rank.keys >= 0)
            self.pair = dict(zip(self.rank.keys[here].tolist(), self.rank.values[here].tolist(), strict=True))
        pair, made = self.pair, self.made
        ids = self.single[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        found = ((pair.get(a << 32 | b), i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False)))
        heap = [x for x in found if x[0] is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            if ids[i] != a or (j := after[i]) >= n or ids[j] != b:
                continue
            new, k = int(made[rank]), after[j]
            ids[i], ids[j], after[i] = new, -1, k
            if k < n:
                before[k] = i
                if (r := pair.get(new << 32 | ids[k])) is not None:
                    heapq.heappush(heap, (r, i, new, ids[k]))
            if (h := before[i]) >= 0 and (r := pair.get(ids[h] << 32 | new)) is not None:
                heapq.heappush(heap, (r, h, ids[h], new))
        return np.array([x for x in ids if x >= 0], np.int32)

    def _merge_rows(self, all_ids: np.ndarray) -> None:
        none = np.int32(2**31 - 1)

        def ranks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            found = self.rank((a.astype(np.int64) << 32 | b).ravel() & 0x7FFFFFFFFFFFFFFF).reshape(a.shape)
            return np.where((found < 0) | (a < 0) | (b < 0), none, found).astype(np.int32)

        if all_ids.shape[1] < 2:
            return
        rows, ids = np.arange(len(all_ids)), all_ids.copy()
        rank = ranks(ids[:, :-1], ids[:, 1:])
        column = np.arange(all_ids.shape[1])
        while len(rows):
            j = rank.argmin(axis=1)
            least = rank[np.arange(len(j)), j]
            done = least == none
            if done.any():
                all_ids[rows[done]] = ids[done]
                rows, ids, rank, j, least = rows[~done], ids[~done], rank[~done], j[~done], least[~done]
                if not len(rows):
                    break
            k = np.arange(len(j))
            # the merged pair becomes one id, what follows moves up
            source = np.minimum(column + (column > j[:, None]), column[-1])
            ids = np.take_along_axis(ids, source, axis=1)
            ids[:, -1] = -1
            ids[k, j] = self.made[least]
            rank = np.take_along_axis(rank, np.minimum(source[:, :-1], column[-1] - 1), axis=1)
            rank[:, -1] = none
            right = np.where(j + 1 < len(column), ids[k, np.minimum(j + 1, column[-1])], -1)
            last = j >= rank.shape[1]
            rank[k[~last], j[~last]] = ranks(ids[k, j], right)[~last]
            left = np.flatnonzero(j > 0)
            rank[left, j[left] - 1] = ranks(ids[left, j[left] - 1], ids[left, j[left]])

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


def minimal_automaton(words: Iterable[bytes]) -> dict[str, np.ndarray]:
    """Arrays of the minimal automaton of sorted distinct words: arcs by state, each with its byte, target and the words before it.

    State s has the arcs first[s] to first[s + 1]; ``final`` says whether a word ends there. State 0 is the start.
    """
    register: dict[tuple, int] = {}
    states: list[tuple] = []  # (final, ((byte, state), ...)) of the states that are settled
    open_: list[list] = [[False, []]]  # of the last word's states: final, arcs
    last = b""

    def settle(down_to: int) -> None:
        while len(open_) > down_to:
            final, arcs = open_.pop()
            key = (final, tuple(arcs))
            if (s := register.get(key)) is None:
                s = register[key] = len(states)
                states.append(key)
            if open_:
                open_[-1][1][-1] = (open_[-1][1][-1][0], s)

    for word in words:
        same = next((i for i, (a, b) in enumerate(zip(word, last, strict=False)) if a != b), min(len(word), len(last)))
        settle(same + 1)
        for b in word[same:]:
            open_[-1][1].append((b, -1))
            open_.append([False, []])
        open_[-1][0], last = True, word
    settle(0)
    # the start is settled last: states are renumbered so that it is 0
    n = len(states)
    held = np.zeros(n, np.int64)  # words below each state; targets are settled before their sources
    first, byte, to, skip, final = [0], [], [], [], []
    for s, (ends, arcs) in enumerate(states):
        held[s] = ends + sum(held[t] for _, t in arcs)
    for s in range(n - 1, -1, -1):
        ends, arcs = states[s]
        before = int(ends)
        for b, t in arcs:
            byte.append(b), to.append(n - 1 - t), skip.append(before)
            before += int(held[t])
        first.append(len(byte)), final.append(ends)
    return {
        "first": np.array(first, np.int32),
        "byte": np.array(byte, np.uint8),
        "to": np.array(to, np.int32),
        "skip": np.array(skip, np.int32),
        "final": np.array(final, np.uint8),
    }


FIELDS = (("first", np.int32), ("to", np.int32), ("skip", np.int32), ("ids_at", np.int32), ("ids", np.int32), ("byte", np.uint8), ("final", np.uint8))


def compile_lexicon(words: Iterable[str], vocabulary: Vocabulary) -> bytes:
    """The transducer of the words as one block of bytes: the fields' lengths, then the fields."""
    keys = sorted({w.encode("utf-8", "surrogatepass") for w in words} - {b""})
    fields = minimal_automaton(keys)
    lengths, fields["ids"] = vocabulary.merge(keys)  # in the order of the ranks
    fields["ids_at"] = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    lengths = np.array([len(fields[k]) for k, _ in FIELDS], np.int64)
    return lengths.tobytes() + b"".join(fields[k].astype(t).tobytes() for k, t in FIELDS)


class Lexicon:
    """A transducer file, mapped into memory."""

    def __init__(self, path: str) -> None:
        self.raw = np.memmap(path, np.uint8, "r")
        lengths, at = self.raw[: 8 * len(FIELDS)].view(np.int64), 8 * len(FIELDS)
        for (name, kind), n in zip(FIELDS, lengths.tolist(), strict=True):
            size = n * np.dtype(kind).itemsize
            setattr(self, name, self.raw[at : at + size].view(kind))
            at += size

        state = np.repeat(np.arange(len(self.final), dtype=np.int64), np.diff(self.first))
        self.arc = Lookup(state << 8 | self.byte, np.arange(len(state), dtype=np.int32))

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """The rank of each word in the lexicon, or -1: all words walk the automaton at once, a byte a step."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        raw, begins = np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size
        rank, state = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        on, step = np.flatnonzero(size > 0), 0
        rank[size == 0] = -1
        while len(on):
            arc = self.arc(state[on] << 8 | raw[begins[on] + step])
            rank[on[arc < 0]] = -1
            on, arc = on[arc >= 0], arc[arc >= 0]
            rank[on] += self.skip[arc]
            state[on] = self.to[arc]
            step += 1
            over = size[on] == step
            ended = on[over]
            rank[ended[self.final[state[ended]] == 0]] = -1
            on = on[~over]
        return rank


class Numbers(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Encoder:
    """Texts to ids: the distinct words of a stretch of texts by the lexicon, those outside it by merging."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None) -> None:
        self.v, self.lexicon = vocabulary, lexicon

    def word_ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(lengths, ids) of the words, one after the other."""
        if self.lexicon is None:
            return self.v.merge(words)
        rank = self.lexicon.ranks(words)
        known, unknown = np.flatnonzero(rank >= 0), np.flatnonzero(rank < 0)
        lengths = np.zeros(len(words), np.int64)
        at = self.lexicon.ids_at[rank[known]]
        lengths[known] = self.lexicon.ids_at[rank[known] + 1] - at
        lengths[unknown], merged = self.v.merge([words[k] for k in unknown.tolist()])
        starts, out = np.cumsum(lengths) - lengths, np.empty(int(lengths.sum()), np.int32)
        out[ragged(starts[known], lengths[known])] = self.lexicon.ids[ragged(at.astype(np.int64), lengths[known])]
        out[ragged(starts[unknown], lengths[unknown])] = merged
        return lengths, out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. Added tokens are words of their own, told apart by their place."""
        index = Numbers()
        rows, added = [], []
        for text in texts:
            words = []
            for k, part in enumerate(self.v.parts(text)):
                if k % 2:
                    added.append((len(rows), len(words), self.v.added[part]))
                    words.append("")
                elif part:
                    words += self.v.pieces(f" {part}" if self.v.prefix and part[0] != " " else part)
            rows.append(np.fromiter(map(index.__getitem__, words), np.int64, len(words)))
        lengths, ids = self.word_ids([w.encode("utf-8", "surrogatepass") for w in index])
        starts, out = np.cumsum(lengths) - lengths, []
        for row in rows:
            out.append(ids[ragged(starts[row], lengths[row])])
        for row, place, token in reversed(added):  # from the end, so that places before stay right
            out[row] = np.insert(out[row], int(lengths[rows[row][:place]].sum()), token)
        return out


def stretches(texts: list[str], size: int = STRETCH) -> Iterator[list[str]]:
    """The texts in order, in lists of at most ``size`` characters or of one text."""
    held, total = [], 0
    for text in texts:
        if held and total + len(text) > size:
            yield held
            held, total = [], 0
        held.append(text)
        total += len(text)
    if held:
        yield held


@cache
def _worker_vocabulary(vocabulary: str) -> Vocabulary:
    """The vocabulary of a Python worker, from the file that Spark has put on its machine."""
    with open(SparkFiles.get(vocabulary), encoding="utf-8") as f:
        return Vocabulary(f.read())


@cache
def _worker_encoder(vocabulary: str, lexicon: str) -> Encoder:
    return Encoder(_worker_vocabulary(vocabulary), Lexicon(SparkFiles.get(lexicon)) if lexicon else None)


def _hand_out(df: DataFrame, content: bytes, ending: str) -> str:
    """``content`` as a file on every executor, sent by the driver; returns its name. Equal content has the same name."""
    name = f"siltworks-{hashlib.sha256(content).hexdigest()[:24]}{ending}"
    sc = df.sparkSession.sparkContext
    if not any(str(x).endswith(name) for x in sc.listFiles):
        path = os.path.join(tempfile.mkdtemp(prefix="siltworks-"), name)
        with open(path, "wb") as f:
            f.write(content)
        sc.addFile(path)
    return name


def _fitting(counts: DataFrame, level: Column, room: int) -> tuple[Column, int]:
    """A test for the highest levels that fit whole into ``room``, and the room that they leave."""
    least = None
    for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("words")).orderBy(F.desc("level")).collect():
        if r["words"] > room:
            break
        room, least = room - r["words"], r["level"]
    return F.lit(False) if least is None else level >= F.lit(least), room


def frequent_words(docs: DataFrame, vocabulary: str, p: Params) -> list[str]:
    """The most frequent words of the whole table, ``lexicon`` of them at most; of the counts on the edge, within a sixteenth of an octave, those first by hash."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v, seen = _worker_vocabulary(vocabulary), Counter()

        def flushed() -> Iterator[pd.DataFrame]:
            told = list(seen.items())
            seen.clear()
            for k in range(0, len(told), 10_000):
                yield pd.DataFrame(told[k : k + 10_000], columns=["word", "n"])

        for batch in batches:
            for text in batch["text"]:
                for part in v.parts(text or "")[::2]:
                    seen.update(v.pieces(part))
                if len(seen) >= p.counted:
                    yield from flushed()
        yield from flushed()

    counts = docs.select("text").mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = cut(counts.withColumn("level", F.floor(F.log2("n") * 16).cast("int")))
    # from the top, the levels of counts that the lexicon has room for, about a thousand; the same over hashes for the one on the edge
    above, room = _fitting(counts, F.col("level"), p.lexicon)
    chosen = counts.where(above)
    if room:
        edge = counts.where(~above)
        edge = edge.join(F.broadcast(edge.agg(F.max("level").alias("level"))), "level").withColumn("h", F.xxhash64("word"))
        first, room = _fitting(edge, -F.pmod("h", F.lit(4096)), room)
        rest = edge.where(~first)
        last = rest.agg(F.min(F.pmod("h", F.lit(4096)))).head()[0]
        rest = rest.where(F.pmod("h", F.lit(4096)) == F.lit(last)).orderBy("h", "word").limit(room)
        chosen = chosen.select("word").union(edge.where(first).select("word")).union(rest.select("word"))
    return [r["word"] for r in chosen.select("word").collect()]  # no more than the lexicon holds


def encoded(
    docs: DataFrame,
    path: str,
    p: Params = Params(),
    keep: tuple[str, ...] = ("doc_id",),
    told: Callable[[pd.DataFrame], pd.DataFrame] | None = None,
    told_schema: str = "ids array<int>, decoded string",
) -> DataFrame:
    """The columns ``keep`` of ``docs`` with ids array<int> of the text and decoded, the text of these ids. ``path``: the tokenizer file, on the driver.

    ``told`` makes of these rows, batch by batch where they are, the columns of ``told_schema`` behind ``keep``; ids that only a digest
    needs aren't moved. Batches go on in stretches of a bounded number of characters.
    """
    with open(path, "rb") as f:
        vocabulary = f.read()
    name = _hand_out(docs, vocabulary, ".json")
    words = frequent_words(docs, name, p)
    lexicon = _hand_out(docs, compile_lexicon(words, Vocabulary(vocabulary.decode())), ".lexicon") if words else ""
    rows = docs.select(*keep, F.coalesce("text", F.lit("")).alias("text"))
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = _worker_encoder(name, lexicon)
        for batch in batches:
            at = 0
            for some in stretches(list(batch["text"])):
                ids = e.encode(some)
                out = batch[list(keep)].iloc[at : at + len(some)]
                at += len(some)
                decoded = pd.Series([e.v.decode(x) for x in ids], dtype=object, index=out.index)
                out = out.assign(ids=ids, decoded=decoded)
                yield told(out) if told else out

    return rows.mapInPandas(encode, f"{schema}, {told_schema}")


def _digested(rows: pd.DataFrame) -> pd.DataFrame:
    ids = [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in rows["ids"]]
    decoded = [hashlib.sha256(x.encode()).hexdigest() for x in rows["decoded"]]
    return rows.drop(columns=["ids", "decoded"]).assign(n_tokens=rows["ids"].map(len), ids_sha256=ids, decoded_sha256=decoded)


def digests(docs: DataFrame, path: str, p: Params = Params()) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every row of ``docs``: ``encoded``, with digests made where the ids are."""
    return encoded(docs, path, p, told=_digested, told_schema="n_tokens long, ids_sha256 string, decoded_sha256 string")
