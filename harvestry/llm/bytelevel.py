"""What byte-level BPE files hold, and how texts are cut into pre-tokens before any merge."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import regex
from pyspark.sql import SparkSession

#: Fixed value: the pattern that cuts a text into pre-tokens.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Code points of a text that are cut at a time.
WINDOW = 1 << 20
#: Words that are remembered where they are costly, and where they are cheap; and code points of the longest of them.
REMEMBERED, FEW, LONGEST = 250_000, 60_000, 64

_pretokens = regex.compile(PATTERN).findall
_odd_space = re.compile(r"[^\S \n]").search
_safe_cut = re.compile(r"(?<=\S) (?=\S)")


class Vocabulary:
    """A byte-level BPE file of the tokenizers library: ``labels`` by id, ``merges`` in order, ``specials``."""

    def __init__(self, source: str):
        parsed = json.loads(source)
        model, added = parsed["model"], parsed.get("added_tokens") or []
        cut = parsed.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or parsed.get("normalizer") or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError("only byte-level BPE without normalizer, prefix space, dropout or ignored merges is supported")
        if any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in added):
            raise ValueError("added tokens that strip or need word bounds are not supported")
        spelled = self.byte_characters()
        self.ids = {bytes(spelled[c] for c in word): i for word, i in model["vocab"].items() if all(c in spelled for c in word)}
        self.specials = {a["content"]: a["id"] for a in added}
        self.labels = [b""] * (1 + max([*self.ids.values(), *self.specials.values()]))
        for word, i in self.ids.items():
            self.labels[i] = word
        for word, i in self.specials.items():
            self.labels[i] = word.encode()
            self.ids.pop(word.encode(), None)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merges = [tuple(model["vocab"][w] for w in (u, v, u + v)) for u, v in pairs]

    @staticmethod
    def byte_characters() -> dict[str, int]:
        """Printable Latin-1 bytes stand for themselves, the others for the code points from 256 on, in order."""
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}

    def parts(self, text: str) -> list[tuple[str, int | None]]:
        """The text between special strings, and those strings with their ids."""
        if not any(s in text for s in self.specials):
            return [(text, None)]
        cut = re.split("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")", text)
        return [(p, self.specials[p] if k % 2 else None) for k, p in enumerate(cut) if p]


def read_source(spark: SparkSession, path: str) -> str:
    """The vocabulary file ``path``, a file beside the driver; some MB, which tasks get by broadcast."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def chunks(text: str) -> Iterator[list[str]]:
    """The text cut at blanks that always start a pre-token, a list for each window of a long text.

    Every chunk but the very first stands for itself with one blank before it. A blank between two other
    characters starts a pre-token; only where white space meets white space does the cut depend on both sides.
    """
    while text:
        head, cut = text, None
        if len(text) > WINDOW and (cut := _safe_cut.search(text, WINDOW)):
            head = text[: cut.start()]
        plain = "  " not in head and "\n " not in head and " \n" not in head and not _odd_space(head)
        yield head.split(" ") if plain else _safe_cut.split(head)
        text = text[cut.end() :] if cut else ""


def pretokens(chunk: str) -> list[str]:
    """The pre-tokens of a chunk, its blank included."""
    return _pretokens(chunk)


class Recent(dict):
    """Values by word, made when first asked for; the words of the last one or two rounds are remembered."""

    def __init__(self, make: Callable | None = None, limit: int = REMEMBERED):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, word: str):
        value = self.old[word] if word in self.old else self.make(word)
        if len(word) <= LONGEST:
            self.put(word, value)
        return value

    def put(self, word: str, value) -> None:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[word] = value
