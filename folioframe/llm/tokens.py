"""Tokenizers over whole texts, with the work done once per distinct space-delimited chunk.

A byte-level or word-level BPE never merges across its pre-tokens. A single space between two characters that
are no white space always starts a pre-token in the two vocabularies used here, so encoding the chunks between
such spaces one by one and joining the ids is the same as encoding the text. Special tokens' strings in a text
are ordinary text, as the tokenizers' guide sets it.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import Growing, WordCache, shared, split_words

#: Longer chunks are encoded each time they come up, so that the cache stays small.
LONGEST_CACHED = 64
#: Words joined into one text for the tokenizer.
JOINED = 64
#: Words whose ids are put in their places at a time, which bounds the memory that takes.
PLACED = 500_000


#: White space, and a space or line feed that has other white space or an end of the text beside it.
WHITE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
ODD = rf"{WHITE}[ \n]|[ \n]{WHITE}|^[ \n]|[ \n]$|\x00"

#: What begins words of a vocabulary that keeps white space; and words of Latin letters that never become two, with a stop,
#: which make two pre-tokens of one that drops it.
EDGES = (" ", "\n")
STOPPED = re.compile(r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+[.,;:!?]").fullmatch
#: What may stand beside a word's last letter as a word of its own; letters of one byte, and first bytes of letters of two (to U+023F, all but the signs of times and division).
STOPS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
LETTERS, LEADS = (np.isin(np.arange(256), x) for x in (np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", np.uint8), np.arange(0xC3, 0xC9)))


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def lengths_of(words: list[str]) -> np.ndarray:
    return np.fromiter(map(len, words), np.int64, len(words))


class ChunkTokenizer:
    """Cached encoding of words. New words are encoded many at a time. Where white space is kept, each begins with a space
    or line feed, which begins a token that no other place has; where it is dropped, each run of letters or stops ends with
    a token that ends a word. Words of other kinds have a separator between them that encodes to an id of its own and
    stands apart from any word. So their ids can be told apart again."""

    def __init__(self, path: str, most: int = 500_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.t.encode_special_tokens = True
        self.drops_space = self._ids_of("a b") == self._ids_of(" a\t\n b ") and self._ids_of(" ") == []
        self.drops_case = self._ids_of("A Word") == self._ids_of("a word")
        self.separator, self.mark = (" \x01 ", "\x01") if self.drops_space else ("\n", "\n")
        self.separator_id = self._ids_of(self.mark)[0]
        a, b = ("it", "was.") if self.drops_space else (" it", " was.")
        assert self._ids_of(a + self.separator + b) == [*self._ids_of(a), self.separator_id, *self._ids_of(b)], "the separator does not stand apart"
        self.ids, self.first, self.count = Growing(np.int32), Growing(np.int64), Growing(np.int64)
        vocabulary = self.t.get_vocab(with_added_tokens=True)
        self.edge = np.zeros(max(vocabulary.values()) + 1, bool)
        self.edge[[i for x, i in vocabulary.items() if (x.endswith("</w>") if self.drops_space else x[:1] in ("\u0120", "\u010a"))]] = True  # byte-level space and line feed
        self.stops = np.zeros(256, bool)
        if not self.drops_space:
            self.stops[[ord(x) for x in STOPS if all(self._begins(a, x + b) for a in (" it", "\u00e9") for b in ("", "s", "9", "."))]] = True
        self.cache = WordCache(self._compute, self._clear, most, self._keep)

    def _begins(self, word: str, rest: str) -> bool:
        """Whether `rest` begins a pre-token after a word's last letter, and is then cut as if it stood alone."""
        cut = lambda x: [p for p, _ in self.t.pre_tokenizer.pre_tokenize_str(x)]
        return cut(word + rest) == cut(word) + cut(rest)

    def _clear(self) -> None:
        for x in (self.ids, self.first, self.count):
            x.reset()

    def _keep(self, rows: np.ndarray) -> None:
        firsts, counts = self.first.a[rows], self.count.a[rows]
        ends = np.cumsum(counts)
        ids = self.ids.a[np.repeat(firsts - (ends - counts), counts) + np.arange(int(counts.sum()))]
        self._clear()
        self.first.add(ends - counts)
        self.count.add(counts)
        self.ids.add(ids)

    def _ids_of(self, text: str) -> list[int]:
        return self.t.encode(text, add_special_tokens=False).ids

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.t.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_apart(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The words' ids in a row, and how many each has. The separator must not be part of a word, and words of a
        vocabulary that keeps white space must begin with a space and end without."""
        found = [np.array(e.ids, np.int32) for e in self.t.encode_batch_fast([self.separator.join(words[i : i + JOINED]) for i in range(0, len(words), JOINED)], add_special_tokens=False)]
        flat = np.concatenate([x for f in found for x in (f, [self.separator_id])]).astype(np.int32)
        ends = np.flatnonzero(flat == self.separator_id)
        assert len(ends) == len(words)
        return flat[flat != self.separator_id], np.diff(ends, prepend=-1) - 1

    def _encode_edged(self, words: list[str], edges: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """The same for words told apart by their edges, of which none can have fewer than these; None if any has more."""
        joined = (" " if self.drops_space else "").join
        flat = np.array([i for e in self.t.encode_batch_fast([joined(words[i : i + JOINED]) for i in range(0, len(words), JOINED)], add_special_tokens=False) for i in e.ids], np.int32)
        at = np.flatnonzero(self.edge[flat])
        if len(at) != edges.sum():
            return None
        at = at[np.cumsum(edges) - 1]
        return flat, np.diff(at, prepend=-1) if self.drops_space else np.diff(at, append=len(flat))

    def _encode_alone(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        own = self._encode(words)
        return np.array([i for x in own for i in x], np.int32), np.fromiter(map(len, own), np.int64, len(own))

    def _compute(self, words: list[str]) -> None:
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            if self.drops_space:
                ends = [1 if w.isalpha() else 2 if STOPPED(w) else 0 for w in part]
                apart = [not e and self.mark not in w for e, w in zip(ends, part)]
            else:
                ends = [len(w) > 1 and w[0] in EDGES and not (w[1].isspace() or w[-1].isspace()) for w in part]
                apart = [False] * len(part)
            ends = np.array(ends, np.int64)
            kinds = np.where(ends > 0, 0, np.where(apart, 1, 2))
            total, firsts, found, n = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64), [], 0
            for kind, encode in enumerate((self._encode_edged, self._encode_apart, self._encode_alone)):
                which = np.flatnonzero(kinds == kind)
                if not len(which):
                    continue
                some = part if len(which) == len(part) else [part[i] for i in which.tolist()]
                ids, counts = encode(some, *([ends[which]] if kind == 0 else [])) or (self._encode_apart if self.drops_space else self._encode_alone)(some)
                total[which], firsts[which] = counts, n + np.cumsum(counts) - counts
                found.append(ids)
                n += len(ids)
            self.first.add(self.ids.n + firsts)
            self.count.add(total)
            self.ids.add(np.concatenate(found) if len(found) != 1 else found[0])

    def _odd(self, text: str) -> np.ndarray:
        """Ids of a text that has a space beside other white space."""
        cut = re.split(r"(?<=\S) (?=\S)", text)
        return np.array([i for x in self._encode([cut[0], *(" " + x for x in cut[1:])]) for i in x], np.int32)

    def _encode_words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """encode() for a vocabulary that drops white space and case: words between white space, each by itself."""
        if self.drops_case:  # not other letters, which the tokenizer may compose before it lowers them
            texts = pc.fill_null(texts, "")
            texts = pc.if_else(pc.string_is_ascii(texts), pc.ascii_lower(texts), texts)
        words, codes, per_text = split_words(texts)
        short = lengths_of(words) <= LONGEST_CACHED
        rows = np.zeros(len(words), np.int64)
        rows[short] = self.cache.rows(words if short.all() else [w for w in words if len(w) <= LONGEST_CACHED])
        extra = self._encode([w for w in words if len(w) > LONGEST_CACHED]) if not short.all() else []
        firsts, counts = self.first.a[rows], self.count.a[rows]
        lens = np.fromiter(map(len, extra), np.int64, len(extra))
        firsts[~short], counts[~short] = self.ids.n + np.cumsum(lens) - lens, lens
        store = np.concatenate([self.ids.a[: self.ids.n], np.array([i for x in extra for i in x], np.int32)]) if extra else self.ids.a[: self.ids.n]
        each = counts[codes]
        before = np.concatenate([[0], np.cumsum(each)])
        out = store[np.repeat(firsts[codes] - before[:-1], each) + np.arange(before[-1])] if before[-1] else np.zeros(0, np.int32)
        return out, np.diff(before[np.concatenate([[0], np.cumsum(per_text)])])

    def _split(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Distinct words, each word's place among them, and each text's number of words, for texts that are not ODD.

        A space or line feed between two words begins a pre-token, so a text is cut before each, and it goes with its word.
        So does what follows a word's last letter, so a text is cut before a stop there, and words are the same with it and
        without.
        """
        texts = texts.cast(pa.large_string())
        if not len(texts):
            return [], np.zeros(0, np.int64), np.zeros(0, np.int64)
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        cut = (data == 32) | (data == 10)
        at = np.flatnonzero(self.stops[data])
        at = at[at > 1]
        last, lead = data[at - 1], data[at - 2]
        cut[at[LETTERS[last] | (last >= 0x80) & LEADS[lead] & ~((lead == 0xC3) & ((last == 0x97) | (last == 0xB7)))]] = True
        cut[offsets[:-1][np.diff(offsets) > 0]] = True
        begins = np.flatnonzero(cut)
        per_text = np.diff(np.searchsorted(begins, offsets))
        flat = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(np.append(begins, len(data))), pa.py_buffer(data)).dictionary_encode()
        return flat.dictionary.to_numpy(zero_copy_only=False).tolist(), flat.indices.to_numpy(zero_copy_only=False), per_text

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and the number of ids of each text (null: none)."""
        if self.drops_space:
            return self._encode_words(texts)
        texts = pc.fill_null(texts, "")
        odd = np.flatnonzero(pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False))
        apart = {int(i): self._odd(texts[int(i)].as_py()) for i in odd}
        if apart:
            plain = pc.invert(pc.match_substring_regex(texts, ODD))
            texts = pc.if_else(plain, texts, "")
        words, codes, per_text = self._split(texts)
        starts = np.cumsum(per_text) - per_text
        short = lengths_of(words) <= LONGEST_CACHED
        rows = np.zeros(len(words), np.int64)
        rows[short] = self.cache.rows(words if short.all() else [w for w in words if len(w) <= LONGEST_CACHED])
        firsts, counts, store = self.first.a[rows], self.count.a[rows], self.ids.a[: self.ids.n]
        if not short.all():
            extra, lens = self._encode_alone([w for w in words if len(w) > LONGEST_CACHED])
            firsts[~short], counts[~short] = len(store) + np.cumsum(lens) - lens, lens
            store = np.concatenate([store, extra])
        each = counts[codes]
        before = np.concatenate([[0], np.cumsum(each)])
        out = np.empty(before[-1], np.int32)
        for a in range(0, len(codes), PLACED):
            b = min(a + PLACED, len(codes))
            out[before[a] : before[b]] = store[np.repeat(firsts[codes[a:b]] - before[a:b], each[a:b]) + np.arange(before[a], before[b])]
        totals = np.diff(before[np.concatenate([starts, [len(codes)]])])
        if apart:
            cuts = np.cumsum(totals) - totals
            for i, x in apart.items():
                totals[i] = len(x)
            out = np.concatenate([y for a, b in zip([0, *odd], [*odd, len(totals)]) for y in ((out[cuts[a] : cuts[b]] if b < len(cuts) else out[cuts[a] :]) if a < len(cuts) else out[:0], apart.get(int(b), out[:0]))])
        return out, totals

    def documents(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """As encode(), with end_id after each document."""
        ids, counts = self.encode(texts)
        out = np.full(len(ids) + len(counts), end_id, np.uint32)
        keep = np.ones(len(out), bool)
        keep[np.cumsum(counts + 1) - 1] = False
        out[keep] = ids
        return out, counts + 1


def shared_tokenizer(path: str, most: int = 500_000) -> ChunkTokenizer:
    """One for all tasks of a worker process, so that they share what has been encoded; its cache is bounded."""
    return shared(("tokenizer", path), lambda: ChunkTokenizer(path, most))
