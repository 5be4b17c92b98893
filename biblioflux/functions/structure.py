"""LaTeX body -> element tree, by a scanner with a stack.

Environments and braces nest, which no regular expression follows; the scanner runs inside ``mapInArrow`` (see
``operators.hierarchy.parse``) on whole bodies, and reads them in place: no tail of a text is copied.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

SECTIONS = {"chapter": 0, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4, "subparagraph": 5}
LISTS = {"itemize", "enumerate"}
FLOATS = {"figure": "figure", "figure*": "figure", "table": "table", "table*": "table"}
FORMULAS = {f"{e}{s}" for e in ("equation", "align", "eqnarray", "gather", "multline") for s in ("", "*")} | {"displaymath"}
MAX_DEPTH = 10

_MARK = re.compile(r"\\(?P<sec>chapter|section|subsection|subsubsection|paragraph|subparagraph)\*?\{|\\begin\{(?P<env>itemize|enumerate|figure\*?|table\*?|displaymath|(?:equation|align|eqnarray|gather|multline)\*?)\}|(?P<dollar>\$\$)|(?P<open>\\\[)")
_EXCLUDED = re.compile(r"\b(?:references?|bibliograph(?:y|ie)|cited\s*literature)\b", re.I)
_BRACE = re.compile(r"[{}]")
_HEADING = re.compile(r"\\textbf\{([^}]+\.)\}")
_TITLE_LINE = re.compile(r"^\s*([A-Z][^\n\\]+)\s*$", re.M)
_DOTTED = re.compile(r"\b(?:Dr|Mrs?|Ms|Prof|vs|etc|Fig|Eq|No|Vol|et al)\.|\be\.g\.|\bi\.e\.|\bPh\.D\.|\bM\.D\.|\bU\.S\.|\bU\.K\.|\bA\.I\.|\bM\.L\.")
_FIGURES = re.compile(r"[\d\s%.,;:]+")


@dataclass
class Element:
    ord: int
    kind: str
    parent: int
    text: str


def closing_brace(text: str, at: int) -> int:
    """Index of the brace that closes the one before ``at``; -1 if none does."""
    depth = 1
    for m in _BRACE.finditer(text, at):
        depth += 1 if m.group() == "{" else -1
        if not depth:
            return m.start()
    return -1


def environment_end(text: str, at: int, env: str) -> tuple[int, int]:
    """(start, end) of the \\end that matches, counting environments of the same name within."""
    depth = 1
    for m in re.compile(r"\\(begin|end)\{" + re.escape(env) + r"\}").finditer(text, at):
        depth += 1 if m.group(1) == "begin" else -1
        if not depth:
            return m.start(), m.end()
    return len(text), len(text)


def caption(text: str, default: str) -> str:
    m = re.search(r"\\caption\s*\{", text)
    if m:
        end = closing_brace(text, m.end())
        if end > m.end():
            return text[m.end() : end]
    if default == "Table" and (m := _TITLE_LINE.search(text)):
        return m.group(1).strip()
    return default


def split_sentences(text: str) -> list[str]:
    held = _DOTTED.sub(lambda m: m.group().replace(".", "\ue001"), text)
    out = []
    for s in re.split(r"(?<=[.!?])\s+(?=[A-Z0-9])", held):
        s = s.replace("\ue001", ".")
        out += re.split(r"(?<=\.)\s+(?=\d+%)", s) if s.count("%") >= 2 else [s]
    return [s for s in (x.strip() for x in out) if len(s) >= 5 and not _FIGURES.fullmatch(s)]


class Scanner:
    """Elements of one publication version in document order; ord counts from ``first``."""

    def __init__(self, publication: str, first: int = 1):
        self.next = first
        self.elements: list[Element] = []
        self.root = self._add("document", 0, f"Document - {publication}")

    def _add(self, kind: str, parent: int, text: str) -> int:
        self.elements.append(Element(self.next, kind, parent, text))
        self.next += 1
        return self.next - 1

    def scan(self, text: str, parent: int | None = None, depth: int = 0) -> list[Element]:
        parent = self.root if parent is None else parent
        stack = [(-1, parent)]  # (section level, element)
        at = 0
        while at < len(text):
            m = _MARK.search(text, at)
            self._sentences(text[at : m.start() if m else len(text)], stack[-1][1])
            if not m:
                break
            here = stack[-1][1]
            if m["sec"]:
                level = SECTIONS[m["sec"]]
                end = closing_brace(text, m.end())
                if end < 0:
                    at = m.end()
                    continue
                title = text[m.end() : end]
                at = end + 1
                if _EXCLUDED.search(title):  # with all it holds
                    at = self._section_end(text, at, level)
                    continue
                while stack[-1][0] >= level:
                    stack.pop()
                if len(stack) <= MAX_DEPTH:
                    stack.append((level, self._add(m["sec"], stack[-1][1], title)))
            elif m["env"]:
                start, at = environment_end(text, m.end(), m["env"])
                inner = re.sub(r"^\s*\[[^\]]*\]\s*", "", text[m.end() : start]) if m["env"] in FLOATS else text[m.end() : start]
                if m["env"] in LISTS:
                    self._list(inner, m["env"], here, depth)
                elif m["env"] in FLOATS:
                    kind = FLOATS[m["env"]]
                    self._add(kind, here, caption(inner, kind.capitalize()))
                else:
                    self._add("formula", here, text[m.start() : at])
            else:
                close = "$$" if m["dollar"] else "\\]"
                end = text.find(close, m.end())
                if end <= m.end():
                    at = m.end()
                    continue
                at = end + 2
                self._add("formula", here, text[m.start() : at])
        return self.elements

    @staticmethod
    def _section_end(text: str, at: int, level: int) -> int:
        for m in _MARK.finditer(text, at):
            if m["sec"] and SECTIONS[m["sec"]] <= level:
                return m.start()
        return len(text)

    def _list(self, inner: str, env: str, parent: int, depth: int) -> None:
        block = self._add(env, parent, f"{env.capitalize()} block")
        for i, item in enumerate(self._items(inner), 1):
            if "\\begin{itemize}" in item or "\\begin{enumerate}" in item:
                own = self._add("item", block, f"Item {i}")
                if depth < MAX_DEPTH:
                    self.scan(item, own, depth + 1)
            elif item:
                self._add("item", block, item.strip(".,;: \n\t"))

    @staticmethod
    def _items(inner: str) -> list[str]:
        """Texts of the \\item's of this list, those of lists within kept whole."""
        cuts, depth = [], 0
        for m in re.finditer(r"\\(begin|end)\{(?:itemize|enumerate)\}|\\item\b", inner):
            if m.group(1):
                depth += 1 if m.group(1) == "begin" else -1
            elif not depth:
                cuts.append((m.start(), m.end()))
        stops = [a for a, _ in cuts[1:]] + [len(inner)]
        return [inner[b:s].strip() for (_, b), s in zip(cuts, stops)]

    def _sentences(self, text: str, parent: int) -> None:
        for paragraph in re.split(r"\n\s*\n", text):
            paragraph = paragraph.strip()
            at = 0
            for m in _HEADING.finditer(paragraph):
                for s in split_sentences(paragraph[at : m.start()]):
                    self._add("sentence", parent, s)
                self._add("sentence", parent, m.group(1).strip())
                at = m.end()
            for s in split_sentences(paragraph[at:]):
                self._add("sentence", parent, s)
