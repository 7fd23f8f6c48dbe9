"""Operator 10: BPE encoding and decoding of words by a prefix-sharing trie.

The distinct words of a batch make up a trie. A depth-first walk, which takes them in order, keeps, for every prefix on
the current path, the last token of that prefix's encoding; the encoding of a longer prefix ends in the one token that
is a suffix of it and that merges would leave next to the last token before it. So a shared prefix is encoded once,
whatever number of words continue it. Which tokens a prefix ends in is known from its longest suffix that begins a
token, and whether two tokens stay apart from undoing their own merges, so each further symbol costs a few look-ups.

Texts are split at white space first: no pattern of the vocabulary crosses it, so every chunk's ids can be kept.
Null and empty texts encode to no ids. Rows are independent: repeated rows give repeated results; extra columns are
not read. Very long words cost time linear in their length.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

END = "</w>"
#: White space of the vocabulary's patterns (the Unicode property White_Space).
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Fixed value: the pre-tokenizer's pattern.
WORD = regex.compile("'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^" + SPACE + "\\p{L}\\p{N}]+")
SPLIT = regex.compile("[" + SPACE + "]+")
#: Python's str.split() takes these for white space; the vocabulary doesn't.
NOT_SPACE = regex.compile("[\\x1c-\\x1f]")
#: Signs of ASCII that are neither letters nor numbers nor white space.
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Chunks and words whose encoding a worker keeps, and their characters; it starts anew beyond either.
KEEP, KEEP_CHARS = 500_000, 32_000_000
#: Rows and characters whose words share one trie.
ROWS, CHARS = 4096, 8_000_000


def byte_chars() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable, else the next from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


#: A suffix that begins a token; the tokens that a word with it can end in, longest first, with their lengths: before more symbols, and as a whole.
Ends = tuple[str, list[tuple[str, int]], list[tuple[str, int]]]


class TrieEncoder:
    """Encodes words of one vocabulary (a `tokenizers` JSON file of BPE kind with word ends)."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.vocab: dict[str, int] = dict(model["vocab"])
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {p: i for i, p in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.text_of = {i: t for t, i in (self.vocab | self.special).items()}
        self.chars = "".join(byte_chars())
        self.halves = {a + b: (a, b) for a, b in pairs}
        self.made = {t: i for i, t in enumerate(self.halves)}
        #: Whether each token has one merge, which comes after those of its halves.
        self.plain = len(self.halves) == len(pairs) and all(
            self.made[x] < i if x in self.made else len(x.removesuffix(END)) == 1 for i, p in enumerate(pairs) for x in p
        )
        self.inner = {t for t in self.vocab if not t.endswith(END)}
        self.begins = {t[:n] for t in (x.removesuffix(END) for x in self.vocab) for n in range(len(t) + 1)}
        self.ends: dict[str, Ends] = {}
        self.steps: dict[str, Ends] = {}
        self.fits: dict[tuple[str, str], bool] = {}
        self.names = {t: str(i) for t, i in self.vocab.items()}
        self.token_of = {str(i): t for i, t in self.text_of.items()}
        self.chunks = {" " + t: str(i) for t, i in self.special.items()}
        self.held = 0  # characters of the chunks
        self.special_at = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def symbols(self, token: str) -> list[str]:
        """The symbols that merges start from; the last carries the word's end if the token does."""
        if token.endswith(END):
            body = token.removesuffix(END)
            return [*body[:-1], body[-1] + END]
        return list(token)

    def merge(self, parts: list[str]) -> list[str]:
        """Merges of lowest rank first; for the few symbols of one or two tokens."""
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: (self.rank.get((parts[i], parts[i + 1]), 1 << 60), i))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            pair, out, i = (parts[best], parts[best + 1]), [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(pair[0] + pair[1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def fit(self, left: str, right: str) -> bool:
        """Whether merges leave `left` and `right` as they are, side by side ("" at a word's start)."""
        key = (left, right)
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) > 2 * KEEP:
                self.fits.clear()
            if not self.plain:
                known = self.merge((self.symbols(left) if left else []) + self.symbols(right)) == ([left, right] if left else [right])
            elif left:
                known = self.fit("", left) and self.fit("", right) and self.apart(left, right, len(self.made))
            else:
                a, b = self.halves.get(right, ("", ""))
                known = not a or self.fit("", a) and self.fit("", b) and self.apart(a, b, self.made[right])
            self.fits[key] = known
        return known

    def apart(self, left: str, right: str, limit: int) -> bool:
        """Whether no merge of a rank below `limit` joins parts of two tokens: their own merges are undone, last first."""
        rank, made, halves = self.rank, self.made, self.halves
        while True:
            if rank.get((left, right), limit) < limit:
                return False
            a, b = made.get(left, -1), made.get(right, -1)
            if a > b:
                limit, left = a, halves[left][1]
            elif b >= 0:  # of one rank, the merge further left comes first
                limit, right = b + 1, halves[right][0]
            else:
                return True

    def reach(self, grown: str) -> Ends:
        """For a suffix that begins a token, and one more symbol: the same for the longer prefix, and the tokens it ends in."""
        at = next(i for i in range(len(grown) + 1) if grown[i:] in self.begins)
        node = grown[at:]
        if node not in self.ends:
            tails = [node[i:] for i in range(len(node))]
            inner = [(t, len(t)) for t in tails if t in self.inner]
            self.ends[node] = node, inner, [(t + END, len(t)) for t in tails if t + END in self.vocab]
        if len(self.steps) > KEEP:
            self.steps.clear()
        self.steps[grown] = self.ends[node]
        return self.ends[node]

    def encode_words(self, words: set[str]) -> None:
        """Put the encodings of all `words` (not empty) in self.chunks, by one walk over their trie."""
        steps, fits, names = self.steps, self.fits, self.names
        nodes, states, before = [""], [("", 0)], ""  # of the path's first d symbols: what begins a token; the last token, its length
        for word in sorted(words):  # as their bytes in UTF-8 are ordered
            path, shared = codecs.charmap_decode(word.encode(), "strict", self.chars)[0], 0
            for a, b in zip(before, path, strict=False):
                if a != b:
                    break
                shared += 1
            del nodes[shared + 1 :], states[shared + 1 :]
            known, n, before = len(nodes), len(path), path
            node = nodes[-1]
            for depth in range(known, n + 1):
                grown = node + path[depth - 1]
                node, inner, ends = steps.get(grown) or self.reach(grown)
                for last in inner if depth < n else ends:
                    token, size = last
                    left = states[depth - size][0]
                    fit = fits.get((left, token))
                    if fit or fit is None and self.fit(left, token):
                        break
                else:
                    raise ValueError(f"the vocabulary has no symbol for {path[depth - 1] + (END if depth == n else '')!r}")
                if depth < n:
                    nodes.append(node)
                    states.append(last)
            ids, at = [], n
            while at:
                ids.append(names[last[0]])
                at -= last[1]
                last = states[at]
            self.chunks[word] = " ".join(ids[::-1])

    def split(self, chunk: str) -> list[str]:
        """The words of a chunk; letters with signs behind them, as most are, need no pattern."""
        body = chunk.rstrip(SIGNS)
        return [body, chunk[len(body) :]] if body.isalpha() else WORD.findall(chunk)

    def learn(self, chunks: set[str]) -> None:
        """Keep the ids, joined by spaces, of every chunk and of its words, which are chunks of one word."""
        if len(self.chunks) > KEEP or self.held > KEEP_CHARS:
            self.chunks, self.held = {" " + t: str(i) for t, i in self.special.items()}, 0
        new = [c for c in chunks if c not in self.chunks]
        self.held += sum(map(len, new))
        split = {c: self.split(c) for c in new if not c.isalpha()}
        words = {w for ws in split.values() for w in ws}
        words.update(filter(str.isalpha, new))
        self.encode_words({w for w in words if w not in self.chunks})
        for c, ws in split.items():
            self.chunks[c] = " ".join([self.chunks[w] for w in ws])

    def pieces(self, text: str) -> list[str]:
        """The normalised chunks between white space."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # no final-sigma rule
        text = text.lower()
        return list(filter(None, SPLIT.split(text))) if NOT_SPACE.search(text) else text.split()

    def parts(self, text: str) -> list[str]:
        """Chunks of a text in order; special tokens, which stand in the text itself, behind a space."""
        if self.special_at is None or "<|" not in text:
            return self.pieces(text)
        return [y for x in self.special_at.split(text) for y in ([" " + x] if x in self.special else self.pieces(x))]

    def encode_batch(self, texts: list[str]) -> list[str]:
        """The ids of each text, joined by spaces."""
        cut = [self.parts(t) for t in texts]
        self.learn(set().union(*cut))
        return [" ".join(map(self.chunks.__getitem__, cs)) for cs in cut]

    def decoded(self, ids: str) -> str:
        """Tokens joined by spaces, as the library decodes a vocabulary that names no decoder."""
        return " ".join(map(self.token_of.__getitem__, ids.split()))


_ENCODERS: dict[int, TrieEncoder] = {}


def encoder(spec_text: str) -> TrieEncoder:
    """One encoder per worker process and vocabulary."""
    key = hash(spec_text)
    if key not in _ENCODERS:
        _ENCODERS[key] = TrieEncoder(json.loads(spec_text))
    return _ENCODERS[key]


def encode(docs: DataFrame, vocabulary: str, text: str = "text", key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Encode and decode a text column; vocabulary: path of the file on the driver, sent once to each executor.

    Returns the key, n_tokens, ids_sha256, decoded_sha256 and, if asked, the ids and the decoded text themselves.
    """
    with open(vocabulary, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())  # the vocabulary: a few MB, whatever the corpus
    more = [pa.field("ids", pa.list_(pa.int32())), pa.field("decoded", pa.string())] if with_ids else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(spec.value)
        for batch in batches:
            for part in slices(batch, 1, ROWS, CHARS):
                ids = code.encode_batch([x or "" for x in part.column(1).to_pylist()])
                decoded = [code.decoded(x) for x in ids]
                cols = [part.column(0), pa.array([x.count(" ") + bool(x) for x in ids], pa.int64())]
                cols += [pa.array([hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in xs]) for xs in (ids, decoded)]
                if with_ids:
                    cols += [pa.array([[int(i) for i in x.split()] for x in ids], pa.list_(pa.int32())), pa.array(decoded)]
                yield pa.RecordBatch.from_arrays(cols, names=["key", "n_tokens", "ids_sha256", "decoded_sha256", *(f.name for f in more)])

    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, schema).withColumnRenamed("key", key)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded by the word vocabulary."""
    import public_tokenizers

    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
