"""Packing token sequences online in bounded space.

Each partition keeps a fixed number of open windows. A document goes into the open window that it
fills best; where none has room the fullest is emitted. What is open at a partition's end is merged
across partitions. Documents may be cut: into whole windows where they are longer than one, and to
top up the window that is emitted.
"""

from __future__ import annotations

import json
import os
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._work import stored, tidy

LENGTH = 4096
OPEN_WINDOWS = 64
#: A gap of fewer tokens is padded rather than filled with so short a piece.
LEAST_PIECE = 32
#: So many partitions' leftovers are merged in one task: at most MERGED * OPEN_WINDOWS windows.
MERGED = 16
#: Entries of the caches, some 15 MB together. Beyond, the half that is asked for most stays.
CACHED_WORDS, CACHED_PIECES = 100_000, 250_000
#: Bytes of text that are tokenized at once; a longer text is cut between words for it.
PORTION = 3 << 19

PIECE = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, part long, win long, offset long, ids binary"


#: What is not plain: plain words are printable, up to U+017F but for U+0130, whose lower case is two
#: characters; their normal form is their lower case. Others are left to the tokenizer one by one.
ODD = regex.compile("[^\n!-~\u00a1-\u012f\u0131-\u017f]")
ODD_RE2 = r"[^\n!-~\x{a1}-\x{12f}\x{131}-\x{17f}]"
SPACE = regex.compile(rb"[ \t-\r]")


def _gathered(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of pool numbered `which`, one after the other, and the end of each."""
    size = sizes[which]
    ends = np.cumsum(size)
    places = np.repeat(starts[which] - ends + size, size)
    places += np.arange(len(places))
    return pool[places], ends


def _joined(names: pa.Array) -> bytes:
    """Words as lines."""
    held = pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names.cast(pa.binary()))
    return pc.binary_join(held, b"\n")[0].as_py()


class _Known:
    """A bounded table of strings and their ids, in Arrow and numpy."""

    def __init__(self, learn, most: int):
        self.learn, self.most = learn, most
        self.names = pa.array([], pa.large_binary())
        self.pool, self.starts, self.sizes, self.hits = np.empty(0, "<u4"), *(np.empty(0, np.int64) for _ in range(3))

    def __call__(self, names: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids and each name's run of them: (pool, starts, sizes). Names are distinct."""
        at = pc.fill_null(pc.index_in(names, value_set=self.names), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = at < 0
        self.hits[at[~new]] += 1
        if new.any():
            fresh = names.filter(pa.array(new))
            pool, sizes = self.learn(fresh)
            at[new] = len(self.names) + np.arange(len(fresh))
            self.names = pa.concat_arrays([self.names, fresh])
            self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(sizes) - sizes])
            self.pool = np.concatenate([self.pool, pool])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.hits = np.concatenate([self.hits, np.ones(len(fresh), np.int64)])
        out = self.pool, self.starts[at], self.sizes[at]
        if len(self.names) > self.most:
            stay = np.sort(np.argsort(-self.hits, kind="stable")[: self.most // 2])
            self.pool, ends = _gathered(self.pool, self.starts, self.sizes, stay)
            self.names, self.sizes, self.hits = self.names.take(pa.array(stay)), self.sizes[stay], self.hits[stay] // 2
            self.starts = ends - self.sizes
        return out


class WordTokens:
    """Ids of texts, put together from words, and words from the pieces that the tokenizer's own
    splitting pattern gives. Exact for tokenizers that lower-case, drop white space, split by a
    pattern and mark a piece's last token with a suffix: no token of theirs spans two pieces. Words
    and pieces are told apart and looked up by Arrow; Python sees a portion's unknown words only."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.path, self.whole = path, None
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        split = told["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        suffix = told["model"]["end_of_word_suffix"]
        self.split = regex.compile(f"\\n|{split}")
        self.special = [t["content"].encode() for t in told["added_tokens"]]
        vocabulary = told["model"]["vocab"]
        self.last = np.zeros(max([*vocabulary.values(), *(t["id"] for t in told["added_tokens"])]) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        # the same model for pieces, which are already normal and need no pattern
        self.model = Tokenizer.from_file(path)
        self.model.normalizer = normalizers.Sequence([])
        self.model.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        self.words, self.pieces = _Known(self._learn_words, CACHED_WORDS), _Known(self._learn_pieces, CACHED_PIECES)

    def _one(self, word: str) -> list[int]:
        if self.whole is None:  # most texts never need it
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.path)
        return self.whole.encode(word, add_special_tokens=False).ids

    def _singly(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [self._one(w) for w in words]
        return np.array([i for x in ids for i in x], "<u4"), np.array([len(x) for x in ids], np.int64)

    def _learn_pieces(self, names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        pieces, out = [p.decode() for p in names.to_pylist()], []
        for k in range(0, len(pieces), 20_000):
            part = pieces[k : k + 20_000]
            ids = np.array(self.model.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            # unequal where the tokenizer cuts a piece in another way
            out.append((ids, np.diff(ends, prepend=0)) if len(ends) == len(part) else self._singly(part))
        return np.concatenate([x for x, _ in out]), np.concatenate([n for _, n in out])

    def _odd(self, names: pa.Array, text: str) -> np.ndarray:
        """Which of the words, whose lines `text` holds, are not plain or hold a special token's text."""
        if "\ufffd" in text:  # bytes that are no UTF-8
            return np.array([bool(ODD.search(t)) or any(x.decode() in t for x in self.special) for t in text.split("\n")], bool)
        odd = pc.match_substring_regex(names, ODD_RE2)
        for x in self.special:
            odd = pc.or_(odd, pc.match_substring(names, x.decode()))
        return odd.to_numpy(zero_copy_only=False)

    def _learn_words(self, names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        n, odd, lines = len(names), None, []
        text = _joined(names).decode("utf-8", "replace")
        if ODD.search(text) or any(x.decode() in text for x in self.special):
            odd = self._odd(names.view(pa.large_string()), text)
            lines = [w.decode("utf-8", "replace") for w in names.filter(pa.array(odd)).to_pylist()]
            text = _joined(names.filter(pa.array(~odd))).decode()
        coded = pa.array(self.split.findall(text.lower()), pa.large_string()).dictionary_encode()
        piece, names = coded.indices.to_numpy(), coded.dictionary
        end = pc.index(names, "\n").as_py()
        ends = piece == end
        word, piece = np.cumsum(ends)[~ends], piece[~ends].astype(np.int64)
        if end >= 0:
            names = names.filter(pc.not_equal(names, "\n"))
            piece -= piece > end
        pool, starts, sizes = self.pieces(names.cast(pa.large_binary()))
        ids, _ = _gathered(pool, starts, sizes, piece)
        plain = np.bincount(word, weights=sizes[piece], minlength=1).astype(np.int64)
        if odd is None:
            return ids, np.concatenate([plain, np.zeros(n - len(plain), np.int64)])
        more, counts = self._singly(lines)
        out = np.zeros(n, np.int64)
        plain_at = np.flatnonzero(~odd)
        out[plain_at[: len(plain)]] = plain[: len(plain_at)]
        out[odd] = counts
        whose = np.repeat(odd, out)
        both = np.empty(len(whose), "<u4")
        both[~whose], both[whose] = ids, more
        return both, out

    def __call__(self, texts: pa.Array) -> tuple[bytes, np.ndarray]:
        """The ids of an array of texts (binary, no nulls), one after the other as little-endian
        32-bit bytes, and the numbers of ids before each text and at the end."""
        lists = pc.ascii_split_whitespace(texts.cast(pa.large_binary()).view(pa.large_string()))
        words = lists.flatten().dictionary_encode()
        ids, ends = _gathered(*self.words(words.dictionary.view(pa.large_binary())), words.indices.to_numpy())
        offsets = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy())))
        return ids.tobytes(), np.concatenate(([0], ends))[offsets]


#: The tokenizer of this Python worker, kept from task to task with its bounded caches.
_TOKENS: dict[str, WordTokens] = {}


def tokens_of(path: str) -> WordTokens:
    if path not in _TOKENS:
        _TOKENS[path] = WordTokens(path)
    return _TOKENS[path]


def _cut(text: bytes, size: int):
    """A text in parts of about `size` bytes, cut between words; a word is never cut."""
    at = 0
    while len(text) - at > size:
        space = SPACE.search(text, at + size)
        end = space.start() if space else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


def _portions(ids: list, texts: pa.Array, size: int):
    """Documents and their texts' ids, tokenized in portions of about `size` bytes: (doc, part, last),
    where last tells whether the text ends with this part."""
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy()
    at = 0
    while at < len(ids):
        if lengths[at] > size:
            parts = list(_cut(texts[at].as_py(), size))
            yield from (([ids[at]], pa.array([p], pa.large_binary()), p is parts[-1]) for p in parts)
            at += 1
            continue
        end = at + max(1, int(np.searchsorted(np.cumsum(lengths[at:]), size, "right")))
        yield ids[at:end], pc.fill_null(texts.slice(at, end - at), b""), True
        at = end


class _Windows:
    """The open windows of one partition."""

    def __init__(self, part: int, emit, length: int, most: int, least: int):
        self.part, self.emit, self.length, self.most, self.least = part, emit, length, most, least
        self.room: list[tuple[int, int]] = []  # (free tokens, window)
        self.held: dict[int, list[tuple]] = {}
        self.next = 0

    def _piece(self, doc, start: int, ids: bytes, tokens: int, win: int, offset: int) -> tuple:
        return (doc, start, len(ids) // 4, zlib.crc32(ids), tokens, self.part, win, offset, ids)

    def _open(self) -> int:
        self.next += 1
        self.held[self.next - 1] = []
        return self.next - 1

    def _place(self, win: int, free: int, piece: tuple) -> None:
        self.held[win].append(piece)
        if free > piece[2]:
            insort(self.room, (free - piece[2], win))
        else:
            self._close(win)

    def _close(self, win: int) -> None:
        self.emit([(*p[:8], None) for p in self.held.pop(win)])

    def add(self, doc, ids: bytes) -> None:
        tokens, start = len(ids) // 4, 0
        while tokens - start >= self.length:
            win = self._open()
            self._place(win, self.length, self._piece(doc, start, ids[4 * start : 4 * (start + self.length)], tokens, win, 0))
            start += self.length
        while start < tokens:
            need = tokens - start
            at = bisect_left(self.room, (need, -1))
            if at < len(self.room):
                free, win = self.room.pop(at)
                take = need
            elif len(self.room) < self.most:
                free, win, take = self.length, self._open(), need
            else:
                free, win = self.room.pop(0)  # the fullest
                take = free
                if free < self.least:
                    self._close(win)
                    continue
            part = ids[4 * start : 4 * (start + take)]
            self._place(win, free, self._piece(doc, start, part, tokens, win, self.length - free))
            start += take

    def leftovers(self) -> list[tuple]:
        return [p for _, win in sorted(self.room) for p in self.held[win]]


def merged(pieces: list[tuple], group: int, length: int) -> list[tuple]:
    """Leftover pieces, cut where a sequence ends, in sequences of `length`; the rest, shorter than
    one, in sequences of powers of two, which need no padding."""
    total = sum(p[2] for p in pieces)
    sizes = [length] * (total // length) + [1 << i for i in range(length.bit_length())[::-1] if (total % length) >> i & 1]
    out, at, filled = [], 0, 0
    for doc, start, n, _, tokens, ids in pieces:
        done = 0
        while done < n:
            take = min(n - done, sizes[at] - filled)
            part = ids[4 * done : 4 * (done + take)]
            out.append((doc, start + done, take, zlib.crc32(part), tokens, (1 << 62) | (group << 32) | at, filled))
            done, filled = done + take, filled + take
            if filled == sizes[at]:
                at, filled = at + 1, 0
    return out


def pack(
    docs: DataFrame, *, tokenizer: str, end: int, id_col: str = "doc_id", text_col: str = "text",
    length: int = LENGTH, open_windows: int = OPEN_WINDOWS, least_piece: int = LEAST_PIECE,
) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's tokens are its text's ids and then `end`; a null or empty text is `end` alone.
    Each row of docs is a document of its own, whatever its id. `tokenizer` is a path that every
    executor can open. Pieces are stored in the shared folder before the leftovers are merged, so
    texts are tokenized once. Memory: one document, a portion of words, the open windows and caches of
    bounded size;
    the merge holds the leftovers of MERGED partitions. An empty table gives no pieces.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = PIECE.format(id=kind)

    def run(batches):
        encode, rows = tokens_of(tokenizer), []
        last = int(end).to_bytes(4, "little")
        windows = _Windows(TaskContext.get().partitionId(), rows.extend, length, open_windows, least_piece)
        names = [c.split()[0] for c in schema.split(", ")]
        types = None

        def out():
            columns = list(zip(*rows, strict=True))
            made = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            rows.clear()
            return pa.RecordBatch.from_arrays(made, names)

        for b in batches:
            types = [b.schema.field("id").type, *[pa.int64()] * 7, pa.binary()]
            before = []  # the parts of a text longer than a portion
            for docs_, texts, whole in _portions(b.column("id").to_pylist(), b.column("t"), PORTION):
                raw, at = encode(texts)
                if not whole:
                    before.append(raw)
                    continue
                for k, (s, e) in enumerate(zip((4 * at[:-1]).tolist(), (4 * at[1:]).tolist(), strict=True)):
                    windows.add(docs_[k], b"".join([*before, raw[s:e], last]))
                    before = []
                if len(rows) >= 4096:
                    yield out()
        rows += windows.leftovers()
        if rows:
            yield out()

    placed = stored(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t")).mapInArrow(tidy(run), schema), "pieces")
    full = placed.where("ids is null").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", F.expr("shiftleft(part, 32) + win").alias("sequence_id"), "offset"
    )

    names_out, schema_out = full.columns, full.schema

    def merge(key, table):
        table = table.sort_by([("part", "ascending"), ("win", "ascending"), ("offset", "ascending")])
        rows = zip(*(table.column(c).to_pylist() for c in ("doc_id", "start", "length", "offset", "doc_tokens", "ids")), strict=True)
        made = list(zip(*merged(list(rows), key[0].as_py(), length), strict=True))
        types = [table.schema.field("doc_id").type, *[pa.int64()] * 6]
        return pa.table([pa.array(c, t) for c, t in zip(made, types, strict=True)], names=names_out)

    open_ = placed.where("ids is not null").withColumn("group", F.expr(f"part div {MERGED}"))
    return full.unionByName(open_.groupBy("group").applyInArrow(merge, schema_out))
