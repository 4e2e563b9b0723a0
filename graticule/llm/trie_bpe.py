"""BPE encoding by depth-first traversal of a trie of distinct words.

The BPE encoding of a prefix is fixed by its last token: what stands before that token
is the encoding of the shorter prefix.  So every trie node carries one state, its last
token, found among the vocabulary's suffixes of the node's path: the right one is
compatible with the last token of the prefix that it leaves, which merges decide
(two tokens are compatible if encoding their concatenation gives the two again).  Words
that share a prefix share its states; each distinct word of a batch is inserted once.

The last character of a word is a symbol of its own (it carries the end-of-word mark),
so a word's last node differs from the same letters inside a longer word.

Texts are prepared as the tokenizer file says: NFC, runs of white space, lower case,
then the pre-token pattern and the byte alphabet.  Special tokens are looked for in the
text as it is.  A null or empty text has no token.
"""

import json
import unicodedata
from array import array
from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, functions as F

CACHE_WORDS = 350_000
# Fixed value: characters with the White_Space property.
WHITE = r"\t-\r\x20\x85\xa0  -     　"
_codecs = {}


def byte_alphabet():
    """Byte -> printable character: printable bytes stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in table:
            table[b] = chr(256 + len(table) - len(plain))
    return table


def lowered(text):
    """Lower case by single characters, without the rule for a final sigma."""
    return text.replace("Σ", "σ").lower()


class TrieCodec:
    def __init__(self, path):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.vocab = model["vocab"]
        self.rank, self.parts = {}, {}
        for r, (a, b) in enumerate(model["merges"]):
            left, right, whole = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.rank[left, right] = (r, whole)
            self.parts.setdefault(whole, (r, left, right))
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = regex.compile(
            "(" + "|".join(regex.escape(t) for t in sorted(self.specials, key=len, reverse=True)) + ")")
        self.tokens = {i: t for t, i in self.vocab.items()} | {
            i: t for t, i in self.specials.items()}
        names = [""] * (max(self.tokens) + 1)
        for i, t in self.tokens.items():
            names[i] = t
        self.names = pa.array(names, pa.string())
        self.pattern = regex.compile(
            r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^" + WHITE + r"\p{L}\p{N}]+")
        self.alphabet = byte_alphabet()
        self.fits, self.sound, self.words, self.chunks = {}, {}, {}, {}
        self._build_suffixes()

    def _build_suffixes(self):
        """Automaton of the vocabulary: after any path, the tokens that end it.

        A state is the longest end of the path that begins a token (Aho and Corasick);
        its tokens are listed longest first, as (token, symbols).
        """
        steps, back, found = [{}], [0], [()]
        for token in self.vocab.values():
            state, marks = 0, self._split(self.tokens[token])
            for symbol in marks:
                below = steps[state].get(symbol)
                if below is None:
                    below = steps[state][symbol] = len(steps)
                    steps.append({})
                    back.append(0)
                    found.append(())
                state = below
            found[state] = ((token, len(marks)),)
        queue = list(steps[0].values())
        for state in queue:
            for symbol, below in steps[state].items():
                queue.append(below)
                end = back[state]
                while end and symbol not in steps[end]:
                    end = back[end]
                back[below] = steps[end].get(symbol, 0)
            found[state] += found[back[state]]
        self.steps, self.back, self.found = steps, back, found

    def _split(self, text):
        """Symbols of a token's string: characters, the last one with its mark."""
        if self.end and text.endswith(self.end) and text != self.end:
            body = text.removesuffix(self.end)
            return [*body[:-1], body[-1] + self.end]
        return list(text)

    # -- merges ------------------------------------------------------------------
    def merge(self, symbols):
        """Plain BPE over symbol ids; for single tokens of the vocabulary only."""
        symbols = list(symbols)
        while len(symbols) > 1:
            found = [self.rank[p] + (i,) for i, p in enumerate(zip(symbols, symbols[1:]))
                     if p in self.rank]
            if not found:
                break
            _, whole, i = min(found, key=lambda x: (x[0], x[2]))
            symbols[i:i + 2] = [whole]
        return symbols

    def is_sound(self, token):
        """Whether a token's own letters encode to it."""
        known = self.sound.get(token)
        if known is None:
            known = self.sound[token] = self.merge(
                [self.vocab[x] for x in self._split(self.tokens[token])]) == [token]
        return known

    def compatible(self, left, right):
        """Whether the encoding of both tokens' letters in a row is the two tokens."""
        if len(self.fits) > 600_000:
            self.fits.clear()
        known = self.is_sound(right) and self._compatible(left, right)
        self.fits[left << 32 | right] = known
        return known

    def _compatible(self, left, right):
        # undo merges from the last one back; a merge across the gap that would have
        # come before the merge undone last breaks the pair
        limit = len(self.rank)
        rank, parts = self.rank, self.parts
        while True:
            across = rank.get((left, right))
            if across is not None and across[0] < limit:
                return False
            a, b = parts.get(left), parts.get(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and a[0] > b[0]):
                limit, left = a[0], a[2]
            else:
                # of equal ranks the left one is merged first
                limit, right = b[0] + 1, b[1]

    # -- the trie ----------------------------------------------------------------
    def encode_words(self, words):
        """Ids (as bytes) of distinct words, non-empty strings over the byte alphabet."""
        root, end, out = {}, self.end, {}
        for word in words:
            node = root
            for c in word[:-1] if end else word:
                below = node.get(c)
                if below is None:
                    below = node[c] = {}
                node = below
            # under the mark lies the word itself, not a further node
            node[word[-1] + end if end else ""] = word
        # by depth on the current branch; deeper places hold remains of other branches
        tokens, sizes, states = ([0] * (max(map(len, words), default=0) + 2) for _ in range(3))
        stack = [iter(root.items())]
        steps, back, found, fits, sound = self.steps, self.back, self.found, self.fits, self.sound
        while stack:
            for symbol, below in stack[-1]:
                depth = len(stack)
                if symbol:
                    state = states[depth - 1]
                    while state and symbol not in steps[state]:
                        state = back[state]
                    state = steps[state].get(symbol, 0)
                    for token, size in found[state]:
                        if size < depth:
                            left = tokens[depth - size]
                            known = fits.get(left << 32 | token)
                            if known is None:
                                known = self.compatible(left, token)
                        else:
                            known = sound[token] if token in sound else self.is_sound(token)
                        if known:
                            break
                    else:
                        raise ValueError(f"no token of the vocabulary ends with {symbol!r}")
                    tokens[depth], sizes[depth], states[depth] = token, size, state
                else:
                    depth -= 1
                if below.__class__ is dict:
                    stack.append(iter(below.items()))
                    break
                ids, at = [], depth
                while at:
                    ids.append(tokens[at])
                    at -= sizes[at]
                out[below] = array("i", ids[::-1]).tobytes()
            else:
                stack.pop()
        return out

    # -- texts -------------------------------------------------------------------
    def pre_tokens(self, chunk):
        """Words over the byte alphabet; special tokens as their ids."""
        out = []
        parts = self.special.split(chunk) if "<|" in chunk else [chunk]
        for part in parts:
            if part in self.specials:
                out.append(self.specials[part])
                continue
            if not part.isascii():
                part = unicodedata.normalize("NFC", part)
            part = lowered(part)
            # letters alone are one word
            for w in [part] if part.isalpha() else self.pattern.findall(part):
                out.append(w if w.isascii() and w.isprintable() else "".join(
                    map(self.alphabet.__getitem__, w.encode("utf-8", "replace"))))
        return out

    def learn(self, chunks):
        """Encode chunks that are not known yet, through one trie of their new words."""
        split = {c: self.pre_tokens(c) for c in chunks}
        new = {w for ws in split.values() for w in ws if isinstance(w, str)} - self.words.keys()
        self.words.update(self.encode_words(new))
        for c, ws in split.items():
            self.chunks[c] = b"".join(
                [self.words[w] if isinstance(w, str) else array("i", [w]).tobytes() for w in ws])

    def encode(self, texts):
        """Ids of each text as 32-bit little-endian numbers."""
        split = [(t or "").replace("\n", " ").split(" ") for t in texts]
        used = {c for chunks in split for c in chunks}
        new = used - self.chunks.keys()
        if new and len(self.chunks) + len(new) > CACHE_WORDS:
            self.chunks.clear()
            self.words.clear()
            new = used
        if new:
            self.learn(new)
        known = self.chunks
        return [b"".join([known[c] for c in chunks]) for chunks in split]

    def decode(self, ids):
        """Token strings joined by a blank: the file names no decoder."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in ids])


def codec(path):
    if path not in _codecs:
        _codecs[path] = TrieCodec(path)
    return _codecs[path]


def encode(text: Column, path: str) -> Column:
    """Token ids of each text as array<int>."""

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tool = codec(path)
        for texts in batches:
            ids = tool.encode(texts.to_pylist())
            ends = np.cumsum([0, *[len(x) // 4 for x in ids]], dtype=np.int32)
            yield pa.ListArray.from_arrays(
                pa.array(ends), pa.array(np.frombuffer(b"".join(ids), dtype="<i4")))

    return run(text)


def decode(ids: Column, path: str) -> Column:
    """Text of each array of ids; a null array gives an empty text."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tool = codec(path)
        for rows in batches:
            rows = pc.fill_null(rows, pa.scalar([], rows.type))
            tokens = tool.names.take(rows.flatten())
            starts = pa.array(np.cumsum([0, *pc.list_value_length(rows).to_pylist()], dtype=np.int32))
            yield pc.binary_join(pa.ListArray.from_arrays(starts, tokens), " ")

    return run(ids)
