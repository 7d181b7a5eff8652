"""Token counts by a count-only Viterbi over a unigram vocabulary.

The vocabulary is that of a sentencepiece file, its scores taken as unigram scores.
An Aho-Corasick automaton lists the pieces that end at each place; the dynamic program
keeps, per place, only the best score and the number of tokens on its path: no path and
no piece is stored. The rules are those of the tokenizers library's Unigram model with
byte fallback, for which `reference` builds a tokenizer: among equal scores the piece
that begins first wins; a character without a piece of its own costs the least score
less UNK_PENALTY; unknown characters that follow each other are one run, with the first
piece of the vocabulary (the unknown one) among them where a text spells it out. A run
counts one token for each byte of UTF-8, or one in all where a byte of it has no piece.

Blanks read as BLANK, and a text that isn't empty gets one in front. Pieces hold a BLANK
only at their front and no line break, so best paths part there: each distinct stretch
is solved once a task. The vocabulary is checked for this and for a piece of every byte;
if it doesn't hold, or a text spells out the unknown piece, texts are solved whole. A
very long text without blanks is one stretch, solved in memory that grows with it. Null and empty texts have 0 tokens. Repeated rows stay; other columns
than doc_id and text are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import ahocorasick
from pyspark.sql import DataFrame

from .common import id_and_text, map_batches

BLANK = "▁"
UNK_PENALTY = 10.0
MEMO = 400_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def vocabulary(source: bytes) -> list[tuple[str, float]]:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_proto=source)
    return [(model.id_to_piece(i), float(model.get_score(i))) for i in range(model.vocab_size())]


def reference(vocab: list[tuple[str, float]]):
    """The library's tokenizer of the same vocabulary, for tests."""
    from tokenizers import Tokenizer, models, normalizers

    out = Tokenizer(models.Unigram(vocab, 0, byte_fallback=True))
    out.normalizer = normalizers.Sequence([normalizers.Prepend(BLANK), normalizers.Replace(" ", BLANK)])
    return out


class Counter:
    def __init__(self, vocab: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        self.unknown = vocab[0][0]
        for piece, score in vocab:
            if piece:
                self.automaton.add_word(piece, (len(piece), score, piece == self.unknown))
        self.automaton.make_automaton()
        self.unk = min(s for _, s in vocab) - UNK_PENALTY
        names = {p for p, _ in vocab}
        self.bytes = frozenset(b for b in range(256) if f"<0x{b:02X}>" in names)
        parted = len(self.bytes) == 256 and not any(BLANK in p.lstrip(BLANK) or "\n" in p and len(p) > 1 for p, _ in vocab)
        self.part = re.compile(f"{BLANK}*[^{BLANK}\n]+|{BLANK}+|\n") if parted else re.compile(r"(?s).+")
        self.memo: dict[str, int] = {}

    def solve(self, text: str) -> int:
        """Tokens of a stretch."""
        size = len(text)
        score, count = [0.0] * (size + 1), [0] * (size + 1)
        runs: dict[int, tuple[int, int | None]] = {}  # end of a run: tokens before it, its bytes (None: one has no piece)

        def unknown(start, end):
            """Tokens up to `end` if the characters from `start` are unknown."""
            before, held = runs.get(start, (count[start], 0))
            own = text[start:end].encode("utf-8", "surrogatepass")
            held = held + len(own) if held is not None and self.bytes.issuperset(own) else None
            return before + (1 if held is None else held), (before, held)

        def settle(place, best, tokens, run, alone):
            """After its pieces: the unknown character may be better, or the only way."""
            if not alone:
                other = score[place - 1] + self.unk
                if best is None or other > best:
                    best = other
                    tokens, run = unknown(place - 1, place)
            score[place], count[place] = best, tokens
            if run is not None:
                runs[place] = run

        place, best, tokens, run, alone = 0, None, 0, None, False
        for end, (length, value, spelled) in self.automaton.iter(text):  # by end, then longest first: by start
            end += 1
            if end != place:
                if place:
                    settle(place, best, tokens, run, alone)
                for skipped in range(place + 1, end):
                    settle(skipped, None, 0, None, False)
                place, best, run, alone = end, None, None, False
            own = score[end - length] + value
            if best is None or own > best:
                best, tokens, run = own, count[end - length] + 1, None
                if spelled:
                    joined, run = unknown(end - length, end)
                    tokens = joined if end - length in runs else tokens  # alone it is a token
            if length == 1:
                alone = True
        if place:
            settle(place, best, tokens, run, alone)
        for skipped in range(place + 1, size + 1):
            settle(skipped, None, 0, None, False)
        return count[size]

    def __call__(self, texts: list[str]) -> list[int]:
        texts = [BLANK + t.replace(" ", BLANK) if t else "" for t in texts]
        parts = [([t] if self.unknown and self.unknown in t else self.part.findall(t)) if t else [] for t in texts]
        new = list(set().union(*parts) - self.memo.keys()) if parts else []
        if len(self.memo) + len(new) > MEMO:
            self.memo.clear()
            new = list(set().union(*parts))
        self.memo.update(zip(new, map(self.solve, new)))
        return [sum(map(self.memo.__getitem__, p)) for p in parts]


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and n_tokens of every row of docs, in one pass without a shuffle."""
    with open(path or default_path(), "rb") as f:
        source = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file, whatever the corpus

    def make():
        counter = Counter(vocabulary(source.value))
        return lambda rows: {"doc_id": rows.column("doc_id"), "n_tokens": counter(rows.column("text").to_pylist())}

    return map_batches(id_and_text(docs), make, "doc_id long, n_tokens long")
