"""JSON objects out of what models write.

``parse_object`` takes strict JSON as it is. Anything else goes through a reader that accepts what models get wrong: text
and fences around the object, single or typographic quotes, words without quotes, True, None and the like, missing or
surplus commas, comments, unescaped quotes and line breaks in strings, numbers such as ``.5``, brackets left open. Of
several objects in a text the first one with a key counts, else the first.
"""

from __future__ import annotations

import json
import re

from verdigraph.functions.prompts import repair_prompt
from verdigraph.inference.engines import Engine

_QUOTES = {'"': '"', "'": "'", "“": "”", "‘": "’", "«": "»", "`": "`"}
_WORDS = {"true": True, "false": False, "null": None, "none": None, "undefined": None, "nan": None}
_NUMBER = re.compile(r"[-+]?(\d[\d_]*\.?\d*|\.\d+)([eE][-+]?\d+)?")
_WHOLE = re.compile(r"([-+]?[\d.][\d_.eE+-]*|true|false|null|none)[ \t]+(?=[\"'{\[])", re.I)
_GAP = re.compile(r"(\s+|//[^\n]*|/\*.*?(\*/|\Z)|#[^\n]*)+", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


class _Reader:
    """One tolerant pass over a text."""

    def __init__(self, text: str) -> None:
        self.text, self.at = text, 0

    def peek(self) -> str:
        """The next sign that counts, '' at the end."""
        if gap := _GAP.match(self.text, self.at):
            self.at = gap.end()
        return self.text[self.at : self.at + 1]

    def value(self, ends: str) -> object:
        c = self.peek()
        if c == "{":
            return self.object()
        if c == "[":
            return self.array()
        if c in _QUOTES and c:
            return self.string(ends)
        return self.bare(ends)

    def object(self) -> dict:
        self.at += 1
        out: dict = {}
        while (c := self.peek()) not in ("", "}"):
            if c in ",;:]":
                self.at += 1
                continue
            before = self.at
            key = self.string(":") if c in _QUOTES else self.bare(":,}", words=False)
            if self.peek() in ("=", ":"):
                self.at += 2 if self.text.startswith("=>", self.at) else 1
                nothing = self.peek() in (",", "}", "")
                out[str(key)] = None if nothing else self.value(",}")
            elif self.at == before:
                self.at += 1
        self.at += 1
        return out

    def array(self) -> list:
        self.at += 1
        out = []
        while (c := self.peek()) not in ("", "]"):
            if c in ",;":
                self.at += 1
                continue
            if c in "}:":
                if c == "}" and "]" not in self.text[self.at :]:
                    break  # an array left open within its object
                self.at += 1
                continue
            out.append(self.value(",]"))
        if self.peek() == "]":
            self.at += 1
        return out

    def string(self, ends: str) -> str:
        """A quoted string. A quote ends it if what follows can follow a string."""
        close = _QUOTES[self.text[self.at]]
        self.at += 1
        out = []
        while self.at < len(self.text):
            c = self.text[self.at]
            if c == "\\" and self.at + 1 < len(self.text):
                out.append(self._escape())
                continue
            self.at += 1
            if c != close or not self._ended(ends):
                out.append(c)
                continue
            return "".join(out)
        return "".join(out)

    def _ended(self, ends: str) -> bool:
        rest = self.text[self.at :].lstrip()
        if not rest or rest[0] in ends + "}]" or (rest[0] == "=" and ":" in ends):
            return rest[:1] != "," or self._opens(rest[1:].lstrip())
        # A comma is missing: the next string or object begins on another line, or a string right after a blank.
        gap = self.text[self.at : len(self.text) - len(rest)]
        return ":" not in ends and bool(gap) and (rest[0] in "{[" or rest[0] in _QUOTES or "\n" in gap or rest.startswith(("//", "/*")))

    @staticmethod
    def _opens(rest: str) -> bool:
        """Whether what follows a comma can be a value or a key."""
        return not rest or rest[0] in '"\'“‘«`{[]}-+.0123456789/#' or bool(re.match(r"(\w+\s*[:=]|(true|false|null|none)\b)", rest, re.I)) or rest[0] == "\n"

    def _escape(self) -> str:
        c = self.text[self.at + 1]
        if c == "u" and (code := re.match(r"[0-9a-fA-F]{4}", self.text[self.at + 2 :])):
            self.at += 6
            high = int(code[0], 16)
            low = re.match(r"\\u([dD][c-fC-F][0-9a-fA-F]{2})", self.text[self.at :]) if 0xD800 <= high < 0xDC00 else None
            if low:
                self.at += 6
                return chr(0x10000 + (high - 0xD800 << 10) + int(low[1], 16) - 0xDC00)
            return "\ufffd" if 0xD800 <= high < 0xE000 else chr(high)
        self.at += 2
        return _ESCAPES.get(c, c)

    def bare(self, ends: str, words: bool = True) -> object:
        """A number or a word without quotes, up to a sign that ends it."""
        if words and (whole := _WHOLE.match(self.text, self.at)):  # a comma is missing after it
            self.at = whole.end()
            return self._plain(whole[1])
        stop = re.compile(r"[\n" + re.escape(ends + "]}") + "]").search(self.text, self.at)
        end = stop.start() if stop else len(self.text)
        said = re.sub(r"\s*(//|/\*).*", "", self.text[self.at : end], flags=re.S).strip()
        self.at = max(end, self.at + (not said))
        if not words:
            return said
        return self._plain(said)

    @staticmethod
    def _plain(said: str) -> object:
        if said.lower() in _WORDS:
            return _WORDS[said.lower()]
        if _NUMBER.fullmatch(said):
            plain = said.replace("_", "").lstrip("+")
            return float(plain) if re.search(r"[.eE]", plain) else int(plain)
        return said


def parse_object(text: str) -> dict:
    """The JSON object in a text, or ValueError."""
    try:
        found = json.loads(text)
    except (ValueError, RecursionError):
        found = None
    else:
        if not isinstance(found, dict):
            raise ValueError(f"a JSON object is needed, not {type(found).__name__}")
        return found
    objects = []
    reader = _Reader(text)
    while (at := text.find("{", reader.at)) >= 0:
        if text[: at].rstrip().endswith("[") and not objects and not text[: at].rstrip()[:-1].strip(" \n`json"):
            raise ValueError("a JSON object is needed, not list")
        reader.at = at
        try:
            objects.append(reader.object())
        except RecursionError:
            raise ValueError("nested too deep") from None
        if objects[-1]:
            return objects[-1]
    if objects:
        return objects[0]
    raise ValueError("this is no JSON object")


def parse_with_repair(text: str, engine: Engine, model: str, attempts: int, shape: str = "object") -> tuple[dict | None, str | None, int]:
    """The object, or None with the last error; and how many repairs were asked for."""
    for attempt in range(attempts + 1):
        try:
            return parse_object(text), None, attempt
        except ValueError as e:
            if attempt == attempts:
                return None, str(e), attempt
            text = engine.generate(model, repair_prompt(text, str(e), shape)).response
    raise AssertionError
