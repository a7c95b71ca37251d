"""Token counts by section: offset-mapped attribution.

A whole text is encoded once. The byte lengths of its tokens give every token's span in code points; the spans are
joined with the sections, which tile the text, by binary search. A token that crosses a boundary is allocated by a
rule: ``first`` (the section of its first character), ``most`` (the section with most of its characters, the first of
equals) or ``split`` (shares in proportion).
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame

from rastertab.llm.byte_bpe import RANKS, encoder
from rastertab.llm.common import over_texts

SECTION_END = "\n"  # a section ends after each match
RULES = ("first", "most", "split")


def token_spans(text: str, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) in code points of tokens of the given byte lengths.

    A token that begins inside a character starts with that character.
    """
    raw = np.frombuffer(text.encode(), np.uint8)
    upto = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))  # characters begun before each byte
    ends = np.cumsum(lengths)
    starts = ends - lengths
    inside = np.concatenate(((raw & 0xC0) == 0x80, [False]))[starts]
    return upto[starts] - inside, upto[ends]


def allocate(starts: np.ndarray, ends: np.ndarray, begins: np.ndarray, size: int, rule: str) -> tuple[np.ndarray, int]:
    """Tokens of each section (starting at ``begins``, tiling ``size`` characters), and how many tokens cross."""
    first = np.searchsorted(begins, starts, side="right") - 1
    last = np.searchsorted(begins, np.maximum(ends - 1, starts), side="right") - 1
    out = np.bincount(first, minlength=len(begins)).astype(np.float64)
    crossing = np.flatnonzero(last > first)
    if rule != "first":
        bounds = np.append(begins, size)
        for t in crossing:
            held = np.arange(first[t], last[t] + 1)
            part = np.minimum(ends[t], bounds[held + 1]) - np.maximum(starts[t], bounds[held])
            out[first[t]] -= 1
            if rule == "most":
                out[held[part.argmax()]] += 1
            else:
                out[held] += part / part.sum()
    return out, len(crossing)


def section_tokens(docs: DataFrame, rule: str = "first", section_end: str = SECTION_END, ranks_file: str = RANKS, keep=("doc_id",)) -> DataFrame:
    """(``keep``…, n_tokens, n_crossing, begins, tokens): per text the start of each section and its tokens.

    The tokens of a text's sections add up to n_tokens under every rule. NULL and empty texts have one empty section
    at 0. Rows are independent, repeated ones and NULL ids included; no rows give no rows.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def start():
        bpe, ends_at = encoder(ranks_file), re.compile(section_end)
        length_of = np.zeros(bpe.size, np.int64)
        for i, b in bpe.bytes_of.items():
            length_of[i] = len(b)

        def step(texts):
            n, cross, begins, tokens = [], [], [], []
            for text, packed in zip(texts, bpe.encode(texts)):
                text = text or ""
                ids = np.frombuffer(packed, "<i4")
                at = np.array([0, *(m.end() for m in ends_at.finditer(text) if m.end() < len(text))])
                counts, crossing = allocate(*token_spans(text, length_of[ids]), at, len(text), rule)
                n.append(len(ids))
                cross.append(crossing)
                begins.append(at)
                tokens.append(counts)
            return [n, cross, begins, tokens]

        return step

    return over_texts(docs, start, "n_tokens bigint, n_crossing bigint, begins array<bigint>, tokens array<double>", keep)
