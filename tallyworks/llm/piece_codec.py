"""SentencePiece encoding and decoding by a streaming Viterbi pass.

The forward pass keeps, for every boundary of the last `widest` characters, the surviving piece that ends there and
where it began. As soon as the paths of all these boundaries run through one boundary, the ids up to it are final
and leave the window. What survives depends on the model:

* unigram: of the pieces that end at a boundary, the one with the largest sum of scores.
* bpe: the one that fits its predecessor. Two pieces fit if merging their joined characters gives back just them;
  exactly one piece per boundary does, and the path over fitting pieces is the sequence that the merges make.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, text_column

SPACE = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CACHED_WORDS, CACHED_PAIRS, CACHED_LENGTH, TRACE_EVERY = 700_000, 1 << 17, 40, 64


class Vocabulary:
    """Pieces with ids and scores; bytes are the ids of the 256 byte pieces, or none."""

    def __init__(self, pieces: dict[str, tuple[int, float]], bytes_: list[int] | None, unknown: int, unigram: bool = False) -> None:
        self.pieces, self.bytes, self.unknown, self.unigram = pieces, bytes_, unknown, unigram
        self.widest = max(map(len, pieces), default=1)
        self.worst = min((s for _, s in pieces.values()), default=0.0) - 10.0
        self.surface = {i: p.replace(SPACE, " ").encode() for p, (i, _) in pieces.items()}
        self.surface.update({i: bytes([b]) for b, i in enumerate(bytes_ or ())})
        self.ends = {p[i:] for p in pieces for i in range(len(p))}
        self.ranks = {p: -s for p, (_, s) in pieces.items()}
        self.splits: dict[str, tuple[str, str] | None] = {}
        self.fits = lru_cache(CACHED_PAIRS)(self._fits)

    @classmethod
    def load(cls, path: str, unigram: bool = False) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        plain = {model.id_to_piece(i): (i, model.get_score(i)) for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
        return cls(plain, [i for i in ids if model.is_byte(i)] or None, model.unk_id(), unigram)

    def ids(self, piece: str) -> list[int]:
        if piece in self.pieces:
            return [self.pieces[piece][0]]
        return [self.bytes[b] for b in piece.encode()] if self.bytes else [self.unknown]

    def split(self, piece: str) -> tuple[str, str] | None:
        """The two symbols whose merge makes the piece last; None where merging its characters makes something else."""
        if piece not in self.splits:
            symbols = list(piece)
            while len(symbols) > 2:
                options = [(self.ranks[s], i) for i in range(len(symbols) - 1) if (s := symbols[i] + symbols[i + 1]) in self.ranks]
                if not options:
                    break
                i = min(options)[1]
                symbols[i: i + 2] = [symbols[i] + symbols[i + 1]]
            self.splits[piece] = tuple(symbols) if len(symbols) == 2 else None
        return self.splits[piece]

    def _fits(self, left: str, right: str) -> bool:
        """Whether merging the characters of both gives just the two.

        The merges that made them are undone, latest first. Between two of these the symbols on either side of the
        boundary stand next to each other; if they have a merge of their own that comes before the next one, or as
        early and further left, it would have crossed the boundary.
        """
        ranks = self.ranks
        if len(right) > 1 and self.split(right) is None:
            return False
        if not left:
            return True
        before = float("inf")
        while True:
            own = ranks.get(left + right)
            if own is not None and own < before:
                return False
            if len(left) > 1 and (len(right) == 1 or ranks[left] > ranks[right]):
                before, left = ranks[left], self.split(left)[1]
            elif len(right) > 1:
                before, right = ranks[right] + 0.5, self.split(right)[0]
            else:
                return True


class Followers(dict):
    """Whether the symbol with a number fits behind one symbol."""

    def __init__(self, symbols: Symbols, left: str) -> None:
        super().__init__()
        self.symbols, self.left = symbols, left

    def __missing__(self, right: int) -> bool:
        out = self[right] = self.symbols.v._fits(self.left, self.symbols.names[right])
        self.symbols.known += 1
        return out


class Symbols:
    """The forward pass over one word that the window holds whole, in numbers instead of strings.

    It is the recurrence of ``Stream.step``: every boundary takes the one symbol whose predecessor fits. As the word is
    no longer than the steps between two traces, nothing is committed before its end. A boundary depends on what stands
    before it only, so boundaries of the front that a word shares with the one before are taken over.
    """

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v, self.known = vocabulary, 0
        # Numbers of pieces and of characters outside them; ends of pieces that are no pieces have none. 0 is the front of a word.
        self.names, self.coded, self.after = [""], [b""], [Followers(self, "")]
        self.number: dict[str, int | None] = {p: None for p in vocabulary.ends}
        for p in vocabulary.pieces:
            self.add(p)
        # Per boundary of the last word: what may follow the symbol that ends there, its number, and where it begins.
        self.text, self.fits, self.numbers, self.starts = "", [self.after[0]], [0], [0]

    def add(self, symbol: str) -> int:
        self.number[symbol] = len(self.names)
        self.names.append(symbol)
        self.coded.append(np.array(self.v.ids(symbol), np.int32).tobytes())
        self.after.append(Followers(self, symbol))
        return self.number[symbol]

    def __call__(self, text: str) -> bytes:
        """The ids of a word as bytes of int32."""
        if self.known > CACHED_PAIRS:
            for known in self.after:
                known.clear()
            self.known = 0
        number, after = self.number.get, self.after
        fits, numbers, starts = self.fits, self.numbers, self.starts
        end = 0
        for mine, last in zip(text, self.text):
            if mine != last:
                break
            end += 1
        self.text = ""
        del fits[end + 1:], numbers[end + 1:], starts[end + 1:]
        for c in text[end:]:
            start = end
            end += 1
            n = number(c)
            if n is None:
                n = self.add(c)
            while n is None or not fits[start][n]:
                start -= 1
                if start < 0:
                    raise ValueError("no piece fits; the model is not one of merges")
                n = number(text[start:end])
            fits.append(after[n])
            numbers.append(n)
            starts.append(start)
        self.text = text
        out = []
        while end:
            out.append(numbers[end])
            end = starts[end]
        coded = self.coded
        return b"".join([coded[n] for n in reversed(out)])


class Stream:
    """One text, fed in parts; gives pieces as they become final."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        # text begins widest characters before base, or at the start.
        self.text, self.first, self.base = "", 0, 0
        # Per boundary from base on: start of the last piece, that piece, score of the path.
        self.starts, self.last, self.scores = [-1], [""], [0.0]

    def feed(self, text: str) -> Iterator[str]:
        for i in range(0, len(text), TRACE_EVERY):
            if len(self.starts) > TRACE_EVERY:
                yield from self.commit(self.meeting())
            (self.step_unigram if self.v.unigram else self.step)(text[i: i + TRACE_EVERY])

    def step(self, more: str) -> None:
        """Extends the paths over pieces that fit."""
        pieces, ends, fits, text = self.v.pieces, self.v.ends, self.v.fits, self.text + more
        starts, last, shift = self.starts, self.last, self.first - self.base
        self.text = text
        for end in range(len(text) - len(more) + 1, len(text) + 1):
            start = end - 1
            piece = text[start:end]
            while not (piece in pieces or start == end - 1) or not fits(last[start + shift], piece):
                start -= 1
                piece = text[start:end]
                if piece not in ends or start + shift < 0:
                    raise ValueError("no piece fits; the model is not one of merges")
            starts.append(start + self.first)
            last.append(piece)

    def step_unigram(self, more: str) -> None:
        """Extends the paths by the piece with the best sum of scores."""
        v, text, shift = self.v, self.text + more, self.first - self.base
        self.text = text
        for end in range(len(text) - len(more) + 1, len(text) + 1):
            best = (float("-inf"), end - 1)
            for start in range(end - 1, max(-1, -shift - 1), -1):
                piece = text[start:end]
                known = v.pieces.get(piece)
                if known is not None or start == end - 1:
                    best = max(best, (self.scores[start + shift] + (known[1] if known else v.worst), start))
                if piece not in v.ends:
                    break
            self.scores.append(best[0])
            self.starts.append(best[1] + self.first)
            self.last.append(text[best[1]: end])

    def meeting(self) -> int:
        """The boundary that the paths of all boundaries in reach have in common."""
        end = self.base + len(self.starts) - 1
        alive = set(range(max(self.base, end - self.v.widest + 1), end + 1))
        while len(alive) > 1:
            latest = max(alive)
            alive.discard(latest)
            alive.add(max(self.base, self.starts[latest - self.base]))
        return alive.pop()

    def commit(self, to: int) -> list[str]:
        """The pieces of the path up to a boundary, which becomes the new base."""
        out, at, n = [], to, to - self.base
        while at > self.base:
            out.append(self.last[at - self.base])
            at = self.starts[at - self.base]
        self.starts, self.last, self.scores = self.starts[n:], self.last[n:], self.scores[n:]
        self.base = to
        cut = max(0, to - self.v.widest - self.first)
        self.text, self.first = self.text[cut:], self.first + cut
        return out[::-1]

    def finish(self) -> list[str]:
        return self.commit(self.base + len(self.starts) - 1)


class Coded(dict):
    """Ids of pieces as bytes of int32."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        super().__init__()
        self.v = vocabulary

    def __missing__(self, piece: str) -> bytes:
        out = self[piece] = np.array(self.v.ids(piece), np.int32).tobytes()
        return out


class Encoder(dict):
    """Ids of words, as bytes of int32. Pieces hold a space sign only at their front, so paths always meet there:
    words between spaces are encoded alone and short ones are kept."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        super().__init__()
        self.v, self.coded = vocabulary, Coded(vocabulary)
        self.symbols = None if vocabulary.unigram else Symbols(vocabulary)
        self.wordwise = not any(SPACE in p.lstrip(SPACE) for p in vocabulary.pieces)

    def pieces(self, text: str) -> Iterator[str]:
        stream = Stream(self.v)
        yield from stream.feed(text)
        yield from stream.finish()

    def __missing__(self, word: str) -> bytes:
        text = SPACE + word
        if self.symbols and len(text) <= TRACE_EVERY:
            out = self.symbols(text)
        else:
            out = b"".join(map(self.coded.__getitem__, self.pieces(text)))
        if len(word) <= CACHED_LENGTH:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = out
        return out

    def words(self, text: str) -> list[str]:
        if not text:
            return []
        text = text.replace(SPACE, " ")
        words = text.split(" ")
        return list(spaced(words)) if "  " in text or text[0] == " " or text[-1] == " " else words

    def __call__(self, text: str) -> bytes:
        return self.all([text])[0]

    def all(self, texts: list[str]) -> list[bytes]:
        """The ids of every text. New words are taken in order, so that each shares its front with the one before."""
        if not self.wordwise:
            spaced_out = (t.replace(SPACE, " ").replace(" ", SPACE) for t in texts)
            return [b"".join(map(self.coded.__getitem__, self.pieces(SPACE + t))) if t else b"" for t in spaced_out]
        listed = [self.words(t) for t in texts]
        for word in sorted({w for ws in listed for w in ws if w not in self and len(w) <= CACHED_LENGTH}):
            self[word]
        return [b"".join(map(self.__getitem__, ws)) for ws in listed]


@lru_cache(1)
def encoder(model: str, unigram: bool) -> Encoder:
    """One encoder a worker, whose words stay for its later tasks."""
    return Encoder(Vocabulary.load(model, unigram))


def spaced(words: list[str]) -> Iterator[str]:
    """Joins every run of spaces with the word after it."""
    run = 0
    for i, w in enumerate(words):
        if w or i == len(words) - 1:
            yield SPACE * run + w
            run = 0
        else:
            run += 1


def decoder(vocabulary: Vocabulary) -> Callable[[list[int]], str]:
    surface = vocabulary.surface
    size = max(surface) + 1 if surface else 1
    table = [surface.get(i, b"") for i in range(size)]
    table[vocabulary.unknown] = " ⁇ ".encode() if vocabulary.bytes is None else b""

    def decode(ids: list[int]) -> str:
        out = b"".join(map(table.__getitem__, ids)).decode("utf-8", "replace")
        return out[1:] if out[:1] == " " else out

    return decode


def encoded(docs: DataFrame, model: str = MODEL, unigram: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids, round_trip) of every row of docs.

    ids has the pieces of the whole text. round_trip tells whether decoding gives the text back, space signs of the
    model's own taken for spaces. A null or empty text has no ids and gives back the empty text. Repeated rows
    repeat; other columns are not read. model is a path that every executor can read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(model, unigram)
        decode = decoder(encode.v)
        for batch, texts in chunks(batches):
            coded = encode.all(texts)
            ids = np.frombuffer(b"".join(coded), np.int32)
            counts = np.fromiter((len(c) // 4 for c in coded), np.int64, len(coded))
            offsets = np.concatenate(([0], np.cumsum(counts)))
            flat = ids.tolist()
            same = [decode(flat[a:b]) == t.replace(SPACE, " ") for a, b, t in zip(offsets, offsets[1:], texts)]
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
            yield pa.record_batch([batch.column("doc_id"), pa.array(counts), lists, pa.array(same, pa.bool_())], names=["doc_id", "n_tokens", "ids", "round_trip"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text"))
    return source.mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, round_trip boolean")


def decoded(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give the empty text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = decoder(Vocabulary.load(model))
        for batch in batches:
            yield pa.record_batch([batch.column("doc_id"), pa.array([decode(x or []) for x in batch.column("ids").to_pylist()], pa.string())], names=["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")
