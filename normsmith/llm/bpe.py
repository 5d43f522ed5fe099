"""BPE encoding and decoding with batched NumPy merge rounds.

The tokenizer file gives the vocabulary, the ordered merges and the special
tokens.  A text is cut at special tokens, brought to NFC, lower-cased and
split into pieces (contractions, letter runs, single digits, other runs);
each piece's bytes become symbols, the last one carrying the word end.  The
new pieces of a batch are merged together: their symbols lie in one flat
array, each round looks up the ranks of new adjacent pairs by binary search
over the sorted pair keys, and every piece merges all places of its
lowest-ranked pair.  Pieces are encoded once and remembered (bounded).

Defined cases: a null or empty text has no tokens and decodes to the empty
text; rows that repeat are all returned; null ids stay null; other columns
are ignored; texts of any length are encoded whole.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

# Pieces remembered by a worker before it starts afresh.
REMEMBERED = 100_000
# Letters and digits that Unicode added after version 16, which
# the tokenizer's pattern does not take for such.
NEWER = regex.compile(
    "[\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d"
    "\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a"
    "\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686"
    "\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda"
    "\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128"
    "\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff"
    "\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4"
    "\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479"
    "\U0003d000-\U0003fc3f]"
)
# Combining marks that Unicode added after version 9, which the
# tokenizer's canonical form neither reorders nor composes.
LATE_MARKS = regex.compile(
    "([\u07fd\u0898-\u089f\u08ca-\u08d3\u09fe\u0c3c\u0d3b-\u0d3c\u0eba\u1715\u1abf-\u1ace\u1df6-\u1dfa\ua82c"
    "\U00010d24-\U00010d27\U00010eab-\U00010eac\U00010efd-\U00010eff\U00010f46-\U00010f50\U00010f82-\U00010f85"
    "\U00011070\U0001133b\U0001145e\U00011839-\U0001183a\U00011930\U0001193d-\U0001193e\U00011943\U000119e0"
    "\U00011a34\U00011a47\U00011a99\U00011d42\U00011d44-\U00011d45\U00011d97\U00011f41-\U00011f42"
    "\U00016ff0-\U00016ff1\U0001e08f\U0001e130-\U0001e136\U0001e2ae\U0001e2ec-\U0001e2ef\U0001e4ec-\U0001e4ef])"
)
# Lower case of code points that Unicode 16 and 17 added, which
# the tokenizer knows and Python's tables may not.
NEWER_LOWER = {
    0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF,
    0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B,
    **{0x10D50 + k: 0x10D70 + k for k in range(22)},
    **{0x16EA0 + k: 0x16EBB + k for k in range(25)},
}


def is_latin1(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte (the usual
    byte-level alphabet: printable Latin-1 as it is, the rest from U+0100)."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = [], 0x100
    for b in range(256):
        if b in plain:
            out.append(chr(b))
        else:
            out.append(chr(extra))
            extra += 1
    return out


class Bpe:
    """Encoder and decoder for a word-end BPE tokenizer file."""

    def __init__(self, definition: str):
        spec = json.loads(definition)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        end = model["end_of_word_suffix"]
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.tokens: list[str] = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.last = np.array([vocab[s + end] for s in symbols], np.int64)
        left, right, merged = [], [], []
        for a, b in model["merges"]:
            left.append(vocab[a])
            right.append(vocab[b])
            merged.append(vocab[a + b])
        keys = np.array(left, np.int64) << 32 | np.array(right, np.int64)
        order = np.argsort(keys)
        self.pair_keys = keys[order]
        self.pair_rank = order.astype(np.int64)
        self.merged = np.array(merged, np.int64)  # by rank
        self.forget()

    def forget(self) -> None:
        """Known pieces: number, ids as little-endian bytes, tokens joined by
        a space."""
        self.known: dict[str, int] = {}
        self.ids: list[bytes] = []
        self.shown: list[str] = []

    # ------------------------------------------------------------- merging
    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the (non-empty) pieces, one after the other, and the
        end of each piece in them."""
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        lengths = np.array([len(p) for p in pieces], np.int64)
        word = np.repeat(np.arange(len(pieces)), lengths)
        sym = self.inner[flat]
        ends = np.cumsum(lengths) - 1
        sym[ends] = self.last[flat[ends]]
        none = len(self.merged)
        rank = np.full(len(sym), none)  # of the pair that starts here
        look = np.flatnonzero(word[:-1] == word[1:])  # pairs whose rank is not known yet
        done_sym, done_word = [], []
        while len(sym):
            pair = sym[look] << 32 | sym[look + 1]
            at = np.searchsorted(self.pair_keys, pair)
            at[at == len(self.pair_keys)] = 0
            rank[look] = np.where(self.pair_keys[at] == pair, self.pair_rank[at], none)
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(word)))
            best_here = np.repeat(best, sizes)
            over = best_here == none  # pieces without a pair left are finished
            if over.any():
                done_sym.append(sym[over])
                done_word.append(word[over])
            where = np.flatnonzero((rank == best_here) & ~over)
            # of overlapping places (a a a) every second one merges, from the left
            if len(where) > 1 and (np.diff(where) == 1).any():
                run = np.flatnonzero(np.append(True, np.diff(where) > 1))
                odd = (np.arange(len(where)) - np.repeat(run, np.diff(np.append(run, len(where))))) & 1
                where = where[odd == 0]
            sym[where] = self.merged[rank[where]]
            stay = ~over
            stay[where + 1] = False
            place = np.cumsum(stay) - 1  # of what stays
            sym, word, rank = sym[stay], word[stay], rank[stay]
            look = place[where]
            rank[look] = none
            look = np.concatenate([look[(look > 0)] - 1, look])
            look = look[look + 1 < len(word)]
            look = np.unique(look[word[look] == word[look + 1]])
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        return sym[np.argsort(word, kind="stable")], np.cumsum(np.bincount(word, minlength=len(pieces)))

    # ------------------------------------------------------------- encoding
    def learn(self, pieces: list[str]) -> None:
        """Encode pieces that are not known yet."""
        flat, ends = self.merge([p.encode("utf-8", "surrogatepass") for p in pieces])
        raw = flat.astype("<u4").tobytes()
        tokens = [self.tokens[i] for i in flat.tolist()]
        at = 0
        for p, end in zip(pieces, ends.tolist()):
            self.known[p] = len(self.ids)
            self.ids.append(raw[4 * at : 4 * end])
            self.shown.append(" ".join(tokens[at:end]))
            at = end

    def pieces(self, text: str) -> list[str]:
        """The pieces of a text without special tokens.  Lower case goes by
        code point (no final-sigma rule)."""
        if text.isascii():
            return self.pattern.findall(text.lower())
        if is_latin1(text):
            return self.pattern.findall(unicodedata.normalize("NFC", text).lower())
        if LATE_MARKS.search(text):
            low = "".join([unicodedata.normalize("NFC", part) for part in LATE_MARKS.split(text)])
        else:
            low = unicodedata.normalize("NFC", text)
        low = low.replace("Σ", "σ").lower().translate(NEWER_LOWER)
        if NEWER.search(low):
            return [low[m.start() : m.end()] for m in self.pattern.finditer(NEWER.sub("!", low))]
        return self.pattern.findall(low)

    def split(self, text: str) -> list[str]:
        if "<|" not in text:
            return self.pieces(text)
        out: list[str] = []
        for part in self.cut.split(text):
            if part in self.special:
                out.append(part)
            elif part:
                out += self.pieces(part)
        return out

    def codes(self, texts: list[str]) -> list[list[int]]:
        """Texts as numbers of known pieces."""
        if len(self.known) > REMEMBERED:
            self.forget()
        if not self.known:
            for token, i in self.special.items():
                self.known[token] = len(self.ids)
                self.ids.append(np.array([i], "<u4").tobytes())
                self.shown.append(token)
        split = [self.split(t) for t in texts]
        new = set().union(*split).difference(self.known)
        if new:
            self.learn(list(new))
        known = self.known
        return [[known[p] for p in pieces] for pieces in split]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(b"".join([self.ids[c] for c in codes]), "<u4") for codes in self.codes(texts)]

    def decode(self, ids) -> str:
        """Tokens joined by a space, special tokens included (the file names
        no decoder)."""
        return " ".join([self.tokens[i] for i in ids])


def encoder(bpe: Bpe, digest: bool):
    """Arrow batches (id, text) -> ids and decoded text of each row, or their
    digests.  The tables are built on the driver (vocabulary and merges of
    one file) and travel with the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe.forget()
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, 500)
                at += part.num_rows
                n, ids, text = [], [], []
                for codes in bpe.codes(part.column(1).to_pylist()):
                    shown = " ".join([bpe.shown[c] for c in codes])
                    raw = b"".join([bpe.ids[c] for c in codes])
                    n.append(len(raw) >> 2)
                    ids.append(hashlib.sha256(raw).hexdigest() if digest else np.frombuffer(raw, "<u4"))
                    text.append(
                        hashlib.sha256(shown.encode("utf-8", "surrogatepass")).hexdigest() if digest else shown
                    )
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(n, pa.int64()),
                        pa.array(ids, pa.string() if digest else pa.list_(pa.int64())),
                        pa.array(text, pa.string()),
                    ],
                    names=["doc_id", "n_tokens", "ids", "decoded"],
                )

    return run


def bpe_encode(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False
) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids (array<long>) and decoded
    (text); with ``digest`` their SHA-256 instead (ids as little-endian
    unsigned 32-bit integers).  ``tokenizer`` is the path of the tokenizer
    file on the driver; its text travels with the tasks."""
    with open(tokenizer, encoding="utf-8") as f:
        bpe = Bpe(f.read())
    small_batches(docs.sparkSession)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    kind = "string" if digest else "array<long>"
    return rows.mapInArrow(encoder(bpe, digest), f"doc_id long, n_tokens long, ids {kind}, decoded string")
