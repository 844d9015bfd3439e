"""Token ids of a public byte-level BPE vocabulary file.

The vocabulary is read from the tokenizers library's own JSON file and encoded by
the rank-merge encoder that shares it: ids are equal (tested against the library)
at a fifth of the time. As in the library's default setting, an added token that is
spelled out in a text stands for its own id; texts are split there first.

The encoder's regular expression keeps a state for each character of a run of white
space and fails on about a million; long runs are split off first, where it would split.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np

#: Characters of a run of white space that is split off, and such a run; the class is that of \s in the vocabulary's pattern.
RUN = 1 << 16
_BLANK = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_LONG = re.compile(f"(?<!{_BLANK}){_BLANK}{{{RUN},}}")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _bytes_of_chars() -> dict[str, int]:
    """The printable stand-in character of each byte, inverted."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(c): b for b, c in [*((b, b) for b in plain), *((b, 256 + i) for i, b in enumerate(rest))]}


@functools.cache
def added(path: str) -> tuple[re.Pattern | None, dict[str, int]]:
    """The vocabulary's added tokens: a pattern that finds them, longest first, and their ids."""
    with open(path, encoding="utf-8") as f:
        tokens = json.load(f).get("added_tokens") or []
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in tokens):
        raise ValueError("added tokens that take in their surroundings are not known here")
    names = sorted((t["content"] for t in tokens), key=len, reverse=True)
    return re.compile("|".join(map(re.escape, names))) if names else None, {t["content"]: t["id"] for t in tokens}


@functools.cache
def encoder(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    back = _bytes_of_chars()
    ranks = {bytes(back[c] for c in piece): i for piece, i in vocab.items() if all(c in back for c in piece) and piece not in added(path)[1]}
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.cache
def width(path: str) -> int:
    """One more than the largest id."""
    return 1 + max(encoder(path).max_token_value, *added(path)[1].values(), 0)


def _plain(text: str, path: str) -> list[int]:
    """Ids of a text without added tokens."""
    tool = encoder(path)
    if len(text) < RUN:
        return tool.encode_ordinary(text)
    out, at = [], 0
    for run in _LONG.finditer(text):
        # the pattern leaves a run's last character to what follows
        end = run.end() - (run.end() < len(text))
        out += tool.encode_ordinary(text[at : run.start()])
        out += tool._encode_single_piece(text[run.start() : end])
        at = end
    return out + tool.encode_ordinary(text[at:])


def ids(text: str | None, path: str) -> np.ndarray:
    """uint32 ids of a whole text; null is empty."""
    if not text:
        return np.zeros(0, np.uint32)
    pattern, known = added(path)
    if pattern is None or not pattern.search(text):
        return np.array(_plain(text, path), np.uint32)
    out, at = [], 0
    for found in pattern.finditer(text):
        out += _plain(text[at : found.start()], path) + [known[found.group()]]
        at = found.end()
    return np.array(out + _plain(text[at:], path), np.uint32)
