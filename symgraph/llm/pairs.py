"""BPE with word ends, by an index of pair occurrences; decoding by the table of pieces.

A vocabulary file of the tokenizers library says how text becomes words: added tokens are cut out of the raw text, the
rest is normalised and split, and the library's own normaliser and splitter do that here.  Merging is done by this
module.  The words that a stretch of a partition (STRETCH characters of its texts) brings in are laid out in one array of
symbols.  `where` maps the rank of each pair to all places at which the pair stands; ranks that have places wait in a
heap.  The lowest rank is applied at all its places, left to right; each merge ends the pairs on its two sides and enters
the two new ones in the lists of their ranks.  Entries whose pair has gone are passed over when their rank comes up.  A
pair can only hold pieces of lower rank, so no rank comes back and each word gets what merging it alone would give;
files whose merges are not in this order are refused.

Neither white space nor what stands on its other side changes how a word is normalised, split or merged, so texts are cut at
ASCII white space, and each distinct chunk is worked out once, from words that are merged once.  Known chunks are
kept up to KEEP characters and words up to WORDS, then forgotten, which changes no result.  Decoding without a decoder puts a space between
pieces, as the library does; a file with a decoder is refused.

Null texts count as empty: no ids, the digest of nothing.  Repeated rows stay, with equal results.  Long texts are taken
in stretches, so memory follows the longest run without white space.  An empty table gives an empty result; columns
other than id and text are not read.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import os
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame

from .common import WORD, map_rows

TOKENIZER = "word_bpe_49k.json"
#: Characters of text whose new words are indexed at once, characters of chunks that are kept, and words that are kept.
STRETCH, KEEP, WORDS = 1 << 21, 1 << 23, 1 << 20
_SPACE = re.compile(r"[\x20\x09-\x0D]")
#: Number of ids of a chunk or word, the ids in decimal and their pieces, each joined by one space.
Chunk = tuple[int, str, str]
_loaded: dict[str, Vocabulary] = {}


class Vocabulary:
    """Merges, pieces and splitting rules of one file, with the chunks worked out so far."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, added = spec["model"], spec["added_tokens"]
        odd = [k for k in ("unk_token", "continuing_subword_prefix", "dropout", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or odd or spec.get("decoder") or any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError(f"{path}: only plain BPE without a decoder is known here {odd}")
        self.ids: dict[str, int] = model["vocab"]
        self.pieces = {i: t for t, i in self.ids.items()} | {t["id"]: t["content"] for t in added}
        self.added = {t["content"]: t["id"] for t in added}
        self.cut = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if added else None
        self.end = model.get("end_of_word_suffix") or ""
        self.letters = {c for c in self.ids if len(c) == 1}
        listed = [pair if isinstance(pair, list) else pair.split(" ") for pair in model["merges"]]
        made = {a + b: rank for rank, (a, b) in enumerate(listed)}
        if len(made) < len(listed) or any(made.get(x, -1) >= rank for rank, pair in enumerate(listed) for x in pair):
            raise ValueError(f"{path}: merges are not in the order of learning")
        self.of_rank = [(self.ids[a], self.ids[b], self.ids[a + b]) for a, b in listed]
        self.merges: dict[int, int] = {a << 32 | b: rank for rank, (a, b, _) in enumerate(self.of_rank)}
        tok = Tokenizer.from_file(path)
        self.normalizer, self.splitter = tok.normalizer, tok.pre_tokenizer
        self.number = {i: str(i) for i in self.pieces}
        self.known: dict[str, Chunk] = {}
        self.known_words: dict[str, Chunk] = {}
        self.kept = 0

    def split(self, chunks: list[str]) -> list[list[str | int]]:
        """Words of each chunk as strings of byte characters; an added token is its id.

        ASCII chunks go through the library in one string: a space parts them for it as white space parts them in a text.
        """
        out: list[list[str | int]] = [[] for _ in chunks]
        plain = [k for k, c in enumerate(chunks) if c.isascii()]
        text = " ".join([chunks[k] for k in plain])
        if self.cut and self.cut.search(text):
            plain = [k for k in plain if not self.cut.search(chunks[k])]
            text = " ".join([chunks[k] for k in plain])
        clean = self.normalizer.normalize_str(text) if self.normalizer else text
        if self.splitter is None or clean != text.lower():
            plain = []
        else:
            at, end, k = -1, -1, -1
            for word, (start, _) in self.splitter.pre_tokenize_str(clean):
                while start > end:
                    at += 1
                    k = plain[at]
                    end += len(chunks[k]) + 1
                out[k].append(word)
        for k in set(range(len(chunks))) - set(plain):
            for part in self.cut.split(chunks[k]) if self.cut else [chunks[k]]:
                if part in self.added:
                    out[k].append(self.added[part])
                elif part:
                    clean = self.normalizer.normalize_str(part) if self.normalizer else part
                    out[k] += [w for w, _ in self.splitter.pre_tokenize_str(clean)] if self.splitter else [clean]
        return out

    def merge(self, words: list[str]) -> list[list[int]]:
        """Ids of each word: all words in one array, all places of a pair in one list, ranks in ascending order."""
        rank_of, ids, end, letter = self.merges.get, self.ids, self.end, self.ids.__getitem__
        symbols: list[int] = [-1]
        starts = []
        for w in words:
            starts.append(len(symbols))
            last = w[-1:] + end
            if last in ids and self.letters.issuperset(w):
                symbols += map(letter, w[:-1])
                symbols.append(ids[last])
            else:  # characters that the vocabulary hasn't are passed over
                symbols += [ids[c] for c in [*w[:-1], last] if c in ids]
            symbols.append(-1)
        after, before = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
        where: dict[int, list[int]] = {}
        for p, (x, y) in enumerate(zip(symbols, symbols[1:])):
            if x >= 0 and y >= 0 and (rank := rank_of(x << 32 | y)) is not None:
                where.setdefault(rank, []).append(p)
        active = list(where)
        heapq.heapify(active)
        while active:
            rank = heapq.heappop(active)
            a, b, new = self.of_rank[rank]
            for p in sorted(where.pop(rank)):
                q = after[p]
                if symbols[p] != a or symbols[q] != b:
                    continue
                o, r = before[p], after[q]
                symbols[p], symbols[q] = new, -2
                after[p], before[r] = r, p
                if (x := symbols[o]) >= 0 and (rank := rank_of(x << 32 | new)) is not None:
                    if (places := where.get(rank)) is None:
                        where[rank] = [o]
                        heapq.heappush(active, rank)
                    else:
                        places.append(o)
                if (x := symbols[r]) >= 0 and (rank := rank_of(new << 32 | x)) is not None:
                    if (places := where.get(rank)) is None:
                        where[rank] = [p]
                        heapq.heappush(active, rank)
                    else:
                        places.append(p)
        out = []
        for p in starts:
            one = []
            while symbols[p] >= 0:
                one.append(symbols[p])
                p = after[p]
            out.append(one)
        return out

    def learn(self, chunks: set[str]) -> dict[str, Chunk]:
        """What is known of chunks without white space, with these in it.

        Nothing here makes reference cycles; looking for them among so many small objects would take a fifth of the time.
        """
        looking = gc.isenabled()
        gc.disable()
        try:
            return self._learn(chunks)
        finally:
            if looking:
                gc.enable()

    def _learn(self, chunks: set[str]) -> dict[str, Chunk]:
        if self.kept > KEEP:
            self.known, self.kept = {}, 0
        if len(self.known_words) > WORDS:
            self.known_words = {}
        known, of_word = self.known, self.known_words
        new = [c for c in chunks if c not in known]
        split = self.split(new)
        words = [w for w in {w for ws in split for w in ws} if w not in of_word]
        strings, number, pieces = [w for w in words if isinstance(w, str)], self.number, self.pieces
        for w, ids in zip(strings, self.merge(strings)):
            of_word[w] = len(ids), " ".join([number[i] for i in ids]), " ".join([pieces[i] for i in ids])
        of_word.update({w: (1, number[w], pieces[w]) for w in words if isinstance(w, int)})
        for c, ws in zip(new, split):
            if len(ws) == 1:
                known[c] = of_word[ws[0]]
                continue
            found = [x for w in ws if (x := of_word[w])[0]]
            known[c] = (sum([x[0] for x in found]), " ".join([x[1] for x in found]), " ".join([x[2] for x in found]))
        self.kept += sum(map(len, new))
        return known

    def decode(self, ids: list[int]) -> str:
        """Pieces with one space between; ids that the file has not are passed over."""
        return " ".join([self.pieces[i] for i in ids if i in self.pieces])


def load(path: str | None = None) -> Vocabulary:
    """The vocabulary of a file, once per Python worker."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def _stretches(texts: list[str | None]) -> Iterator[list[tuple[int, list[str]]]]:
    """(row, chunks) of the texts in lists of about STRETCH characters; a longer text is cut at white space."""
    some, size = [], 0
    for row, text in enumerate(texts):
        at, text = 0, text or ""
        while at < len(text):
            end = len(text)
            if at + STRETCH < end and (space := _SPACE.search(text, at + STRETCH)):
                end = space.start()
            some.append((row, WORD.findall(text, at, end)))
            size += end - at
            at = end
            if size >= STRETCH:
                yield some
                some, size = [], 0
    if some:
        yield some


def encode_batch(texts: list[str | None], path: str | None = None) -> list[list[int]]:
    """Ids of each text."""
    v, out = load(path), [[] for _ in texts]
    for some in _stretches(texts):
        known = v.learn(set().union(*[chunks for _, chunks in some]))
        for row, chunks in some:
            for c in chunks:
                out[row] += map(int, known[c][1].split())
    return out


def decode(ids: list[int], path: str | None = None) -> str:
    return load(path).decode(ids)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """id and ids of each row."""

    def fn(cols: dict) -> dict:
        return {id_col: cols[id_col], "ids": encode_batch(cols[text_col], path)}

    return map_rows(docs.select(id_col, text_col), fn, f"`{id_col}` {dict(docs.dtypes)[id_col]}, ids array<int>")


def decode_ids(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """id and text of each row of ids; null ids count as none."""

    def fn(cols: dict) -> dict:
        return {id_col: cols[id_col], "text": [decode(x or [], path) for x in cols[ids_col]]}

    return map_rows(encoded.select(id_col, ids_col), fn, f"`{id_col}` {dict(encoded.dtypes)[id_col]}, text string")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Encode each text, decode its ids, and give the digests of both; map only."""

    def fn(cols: dict) -> dict:
        v, texts = load(path), cols[text_col]
        n, of_ids, of_text, begun = [0] * len(texts), [hashlib.sha256() for _ in texts], [hashlib.sha256() for _ in texts], [False] * len(texts)
        for some in _stretches(texts):
            known = v.learn(set().union(*[chunks for _, chunks in some]))
            for row, chunks in some:
                if not chunks:
                    continue
                counts, ids, pieces = zip(*[known[c] for c in chunks])
                if 0 in counts:  # white space that isn't ASCII
                    ids, pieces = [x for x in ids if x], [x for x in pieces if x]
                if ids:
                    n[row] += sum(counts)
                    gap = " " if begun[row] else ""
                    of_ids[row].update((gap + " ".join(ids)).encode())
                    of_text[row].update((gap + " ".join(pieces)).encode())
                    begun[row] = True
        return {id_col: cols[id_col], "n_tokens": n, "ids_sha256": [h.hexdigest() for h in of_ids], "decoded_sha256": [h.hexdigest() for h in of_text]}

    schema = f"`{id_col}` {dict(docs.dtypes)[id_col]}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_rows(docs.select(id_col, text_col), fn, schema)
