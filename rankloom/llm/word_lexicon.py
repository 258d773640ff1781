"""BPE encoding through a minimal acyclic word automaton.

The corpus's frequent words, with the token ids that the vocabulary's merges
give them, are compiled into a minimal acyclic automaton: words share prefixes
and suffixes, and a count on every transition turns the path of a word into its
number, which is the place of its ids (a transducer in effect). The automaton
is a few flat arrays, broadcast once and memory-mapped by each worker. Words
outside it are merged exactly, many at once.

The vocabulary's own normaliser and word pattern are followed for texts of
Latin characters by a compiled pattern, and for all other texts by the library.
"""

from __future__ import annotations

import functools
import json
import mmap
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.frames import by_bytes, id_text
from rankloom.session import materialize

LEXICON_WORDS = 65_536
CHUNK_BYTES = 4 << 20
LONGEST = 48
NONE = np.int64(1) << 40


# --- vocabulary -------------------------------------------------------------

def byte_symbols() -> list[str]:
    """The character that stands for each byte: printable ones for themselves,
    the others, in order, for the characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """Symbols and ranked merges of a word-end BPE file."""

    def __init__(self, path: str | None) -> None:
        if path is None:
            import public_tokenizers

            path = str(public_tokenizers.path("word_bpe_49k.json"))
        self.path = path
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        ids = model["vocab"]
        self.end = model["end_of_word_suffix"]
        self.names = {i: token for token, i in ids.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names.update({i: token for token, i in self.special.items()})
        symbols = byte_symbols()
        self.inner = np.array([ids[c] for c in symbols], np.int64)
        self.final = np.array([ids[c + self.end] for c in symbols], np.int64)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        key = np.array([ids[a] << 20 | ids[b] for a, b in merges], np.int64)
        made = np.array([ids[a + b] for a, b in merges], np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks, self.made = key[order], order.astype(np.int64), made[order]

    def rank(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged id) of packed pairs; rank ``NONE`` where nothing merges."""
        at = np.minimum(np.searchsorted(self.keys, pairs), len(self.keys) - 1)
        hit = self.keys[at] == pairs
        return np.where(hit, self.ranks[at], NONE), self.made[at]

    @functools.cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    @functools.cached_property
    def splitter(self) -> re.Pattern:
        return re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")


@functools.lru_cache(maxsize=2)
def vocabulary(path: str | None) -> Vocabulary:
    return Vocabulary(path)


def merge_words(words: list[bytes], vocab: Vocabulary) -> list[np.ndarray]:
    """Token ids of words: the best-ranked pair, leftmost first, until none merges."""
    out: list = [None] * len(words)
    by_length: dict[int, list[int]] = {}
    for k, word in enumerate(words):
        if len(word) > LONGEST:
            out[k] = _merge_long(word, vocab)
        else:
            by_length.setdefault(len(word), []).append(k)
    for length, members in by_length.items():
        raw = np.frombuffer(b"".join([words[k] for k in members]), np.uint8).reshape(len(members), length)
        ids = vocab.inner[raw]
        ids[:, -1] = vocab.final[raw[:, -1]]
        where, sizes = np.array(members), np.full(len(members), length)
        while len(where):
            if ids.shape[1] > 1:
                ranks, made = vocab.rank(ids[:, :-1] << 20 | np.maximum(ids[:, 1:], 0))
                ranks[ids[:, 1:] < 0] = NONE
                best = ranks.argmin(axis=1)
                row = np.arange(len(ids))
                done = ranks[row, best] == NONE
            else:
                done = np.ones(len(ids), bool)
            for k, line, size in zip(where[done].tolist(), ids[done], sizes[done].tolist(), strict=True):
                out[k] = line[:size]
            if done.all():
                break
            go = ~done
            where, sizes, best, row = where[go], sizes[go] - 1, best[go], np.arange(go.sum())
            new = made[go][row, best]
            ids = ids[go]
            ids = np.concatenate((ids, np.full((len(ids), 1), -1)), axis=1)
            after = np.arange(ids.shape[1] - 1)[None, :] > best[:, None]
            ids = np.where(after, ids[:, 1:], ids[:, :-1])
            ids[row, best] = new
            ids = ids[:, :sizes.max()]
    return out


def _merge_long(word: bytes, vocab: Vocabulary) -> np.ndarray:
    """The same for one long word, with a heap over a linked list."""
    import heapq

    raw = np.frombuffer(word, np.uint8)
    ids = vocab.inner[raw]
    ids[-1] = vocab.final[raw[-1]]
    ranks, made = vocab.rank(ids[:-1] << 20 | ids[1:])
    heap = [(int(r), i, int(m)) for i, (r, m) in enumerate(zip(ranks, made, strict=True)) if r != NONE]
    heapq.heapify(heap)
    token = ids.tolist()
    after = [*range(1, len(token)), -1]
    before = [-1, *range(len(token) - 1)]
    pair_at = {i: m for _, i, m in heap}
    found = {}

    def look(i: int) -> None:
        j = after[i]
        if j < 0:
            pair_at.pop(i, None)
            return
        key = token[i] << 20 | token[j]
        if key not in found:
            r, m = vocab.rank(np.array([key]))
            found[key] = (int(r[0]), int(m[0]))
        rank, merged = found[key]
        if rank == NONE:
            pair_at.pop(i, None)
        else:
            pair_at[i] = merged
            heapq.heappush(heap, (rank, i, merged))

    while heap:
        _, i, merged = heapq.heappop(heap)
        if token[i] < 0 or pair_at.get(i) != merged:
            continue
        j = after[i]
        token[i], token[j] = merged, -1
        after[i] = after[j]
        pair_at.pop(j, None)
        if after[i] >= 0:
            before[after[i]] = i
        look(i)
        if before[i] >= 0:
            look(before[i])
    return np.array([t for t in token if t >= 0], np.int64)


# --- automaton --------------------------------------------------------------

def compile_lexicon(words: list[bytes], vocab: Vocabulary) -> dict[str, np.ndarray]:
    """Flat arrays of the minimal automaton of ``words`` and of their token ids.

    Words are added in order; the part of the last word that the next one leaves
    is final, and each of its states is replaced by an equal one seen before.
    ``label`` holds state * 256 + byte, ascending; ``skip`` counts the words that
    come before a transition at its state.
    """
    words = sorted(set(words))
    seen: dict[tuple, int] = {}
    states: list[tuple[bool, tuple]] = []
    path: list[list] = [[False, []]]  # open states of the last word: [final, [(byte, state)]]

    def close(down_to: int, word: bytes) -> None:
        while len(path) > down_to + 1:
            final, arcs = path.pop()
            shape = (final, tuple(arcs))
            if shape not in seen:
                seen[shape] = len(states)
                states.append(shape)
            path[-1][1].append((word[len(path) - 1], seen[shape]))

    last = b""
    for word in words:
        common = len(os.path.commonprefix((last, word)))
        close(common, last)
        for _ in word[common:]:
            path.append([False, []])
        path[-1][0] = True
        last = word
    close(0, last)
    states.append((path[0][0], tuple(path[0][1])))
    below = [0] * len(states)  # words that end at or below a state; states only point back
    label, target, skip, final = [], [], [], np.zeros(len(states), np.int8)
    for s, (ends, arcs) in enumerate(states):
        final[s] = ends
        count = int(ends)
        for byte, to in arcs:
            label.append(s << 8 | byte)
            target.append(to)
            skip.append(count)
            count += below[to]
        below[s] = count
    ids = merge_words(words, vocab)
    starts = np.cumsum([0, *map(len, ids)])
    return {"label": np.array(label, np.int64), "target": np.array(target, np.int32), "skip": np.array(skip, np.int32),
            "final": final, "starts": starts.astype(np.int32),
            "ids": (np.concatenate(ids) if ids else np.empty(0)).astype(np.int32)}


class Lexicon:
    """The automaton, mapped into memory from an anonymous file."""

    def __init__(self, arrays: dict[str, np.ndarray]) -> None:
        total = sum(a.nbytes + 8 for a in arrays.values())
        handle = os.memfd_create("lexicon")
        os.ftruncate(handle, max(total, 1))
        self.map, at = mmap.mmap(handle, max(total, 1)), 0
        os.close(handle)
        for name, array in arrays.items():
            at = (at + 7) // 8 * 8
            self.map[at:at + array.nbytes] = array.tobytes()
            setattr(self, name, np.frombuffer(self.map, array.dtype, len(array), at))
            at += array.nbytes
        self.root = len(self.final) - 1

    def find(self, words: list[bytes]) -> np.ndarray:
        """Number of each word, or -1: one step of all words per byte."""
        number = np.full(len(words), -1)
        if not words or not len(self.label):
            return number
        sizes = np.array([len(w) for w in words])
        raw = np.frombuffer(b"".join(words), np.uint8)
        first = np.cumsum(sizes) - sizes
        live = np.flatnonzero(sizes > 0)
        state, count = np.full(len(live), self.root), np.zeros(len(live), np.int64)
        step = 0
        while len(live):
            key = state.astype(np.int64) << 8 | raw[first[live] + step]
            at = np.minimum(np.searchsorted(self.label, key), len(self.label) - 1)
            hit = self.label[at] == key
            live, at, count = live[hit], at[hit], count[hit]
            state, count = self.target[at], count + self.skip[at]
            step += 1
            over = sizes[live] == step
            ends = over & (self.final[state] == 1)
            number[live[ends]] = count[ends]
            live, state, count = live[~over], state[~over], count[~over]
        return number


# --- texts ------------------------------------------------------------------

_L = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_N = "0-9²³¹¼-¾"
_Z = "\t-\r \x85\xa0"
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_Z}{_L}{_N}]+")
#: Beyond these, lower-casing, composition or letter classes need the library.
_OTHER = re.compile("[^\x00-įı-ſ]")


def words_of_text(text: str, vocab: Vocabulary) -> list[str]:
    """Words of a text without special strings, as the vocabulary's file splits it."""
    if not _OTHER.search(text):
        return _PIECES.findall(text.lower())
    library = vocab.library
    back = _back()
    pieces = library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(text))
    return [bytes([back[c] for c in piece]).decode() for piece, _ in pieces]


@functools.cache
def _back() -> dict[str, int]:
    return {c: b for b, c in enumerate(byte_symbols())}


def encode_texts(texts: list[str], lexicon: Lexicon, vocab: Vocabulary) -> Iterator[tuple[int, str, str]]:
    """(token count, ids joined by spaces, decoded text) per text.

    Every distinct word of the batch is looked up or merged once.
    """
    index: dict[str, int] = {}
    rows = []
    for text in texts:
        parts = vocab.splitter.split(text) if "<|" in text else [text]
        row: list[int] = []
        for k, part in enumerate(parts):
            if k % 2:
                row.append(-vocab.special[part])
            elif part:
                row += [index.setdefault(w, len(index)) for w in words_of_text(part, vocab)]
        rows.append(row)
    words = [w.encode() for w in index]
    number = lexicon.find(words)
    unseen = np.flatnonzero(number < 0)
    merged = dict(zip(unseen.tolist(), merge_words([words[k] for k in unseen], vocab), strict=True))
    starts, stored, names = lexicon.starts, lexicon.ids, vocab.names
    counts, ids, said = [], [], []
    for k, n in enumerate(number.tolist()):
        tokens = merged[k].tolist() if n < 0 else stored[starts[n]:starts[n + 1]].tolist()
        counts.append(len(tokens))
        ids.append(" ".join(map(str, tokens)))
        said.append(" ".join([names[t] for t in tokens]))
    for row in rows:
        if row and min(row) < 0:
            yield (sum(counts[k] if k >= 0 else 1 for k in row),
                   " ".join([ids[k] if k >= 0 else str(-k) for k in row]),
                   " ".join([said[k] if k >= 0 else names[-k] for k in row]))
        else:
            yield sum([counts[k] for k in row]), " ".join([ids[k] for k in row]), " ".join([said[k] for k in row])


def frequent_words(docs: DataFrame, words: int = LEXICON_WORDS) -> list[bytes]:
    """The most frequent letter runs of all texts: at most ``words`` of them, all
    that are more frequent than some limit.

    Counts fold per task before they are shuffled. The limit is found from how many
    words there are per level of frequency, a table of bounded size, so the driver
    gets no more than the lexicon itself.
    """
    runs = F.explode(F.split(F.lower("text"), r"[^\p{L}]+"))
    level = F.floor(F.log2("count") * 16).cast("int").alias("level")
    counted = materialize(docs.select(runs.alias("word")).where("length(word) between 1 and 40").groupBy("word").count()
                          .where("count > 1").select("word", level), "words")
    per_level = {r["level"]: r["count"] for r in counted.groupBy("level").count().collect()}
    limit, taken = None, 0
    for number in sorted(per_level, reverse=True):
        taken += per_level[number]
        if taken > words:
            break
        limit = number
    if limit is None:
        return []
    return [r.word.encode() for r in counted.where(F.col("level") >= limit).collect()]


def encode_documents(docs: DataFrame, path: str | None = None, words: int = LEXICON_WORDS) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of every row, ids joined by spaces.

    Special strings inside texts become their tokens, as the library does by
    default. A null text counts as empty: no tokens. A null doc_id stays null,
    repeated rows are encoded each, an empty table gives an empty one, other
    columns are not carried. The lexicon only saves merges: any word list gives
    the same tokens.
    """
    plain = id_text(docs)
    shared = docs.sparkSession.sparkContext.broadcast(compile_lexicon(frequent_words(plain, words), vocabulary(path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, vocab = Lexicon(shared.value), vocabulary(path)
        for batch in batches:
            texts = batch.column("text")
            for low, high in by_bytes(texts, CHUNK_BYTES):
                found = list(encode_texts(texts.slice(low, high - low).to_pylist(), lexicon, vocab))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(low, high - low), pa.array([x[0] for x in found], pa.int64()),
                     pa.array([x[1] for x in found]), pa.array([x[2] for x in found])],
                    names=["doc_id", "n_tokens", "ids", "decoded"])

    return plain.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids string, decoded string")


def encoding_digests(docs: DataFrame, path: str | None = None, words: int = LEXICON_WORDS) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): ``encode_documents`` with both strings hashed."""
    return encode_documents(docs, path, words).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
