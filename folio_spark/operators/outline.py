"""The outline shape of a text (W9, U4): sections `一、`, items `（一）`, text below them, by a machine over its lines.

A document is one row, so a task reads its lines once, in Arrow batches, and keeps one document's items. Only documents
that are routed here, having neither articles nor `1.` items, are read at all.

Three forms, chosen by the lines as a whole. Flat: `一、` lines that are sentences are the items, unless `（一）` lines
outnumber them. Nested: `（一）` lines are items below sections or chapters, numbered again in each. Sections: without
`（一）` lines each section is an item. Numbers must rise by one; a break, and an item without text, is an issue, and a
document with one has that row alone. Fewer than two items are no outline.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from folio_spark.functions.numerals import NUMERALS

# --- fixed values: marks of sections and items, and what makes a section's line a heading ---------------------------
_N = f"[{NUMERALS}0-9]"
MARK = re.compile(f"^({_N}{{1,3}})、(.*)$", re.S)
ITEM = re.compile(f"^（({_N}{{1,3}})）(.*)$", re.S)
REFERS = re.compile("^[款项目段]")
HEADING_MOST, SENTENCE = 40, re.compile("[。；：]")
STRUCTURE = re.compile(f"^第{_N}+(编|分编|章|节).+|^(附则)$")
LEVELS = ("编", "分编", "章", "节")
CONTENTS = re.compile(
    rf"^目\s*录$|(?:\.{{3,}}|…{{2,}})\s*[-－]?\s*\d{{1,4}}\s*[-－]?\s*$|^(?:第{_N}+(?:编|章|节|分编).+|附则|{_N}{{1,3}}、.+)\s+\d{{1,4}}$|^第{_N}+(?:编|章|节|分编).+?(?:\.{{3,}}|…{{2,}})\s*$"
)
PREAMBLE = "序言"
# --- end of fixed values --------------------------------------------------------------------------------------------

_UNSEEN, _BLANKS = re.compile("[​‌‍⁠﻿]"), re.compile(r"[\s　 ]+")
_LINES = re.compile("\r\n|\r|\n|\f")
_VALUES = {c: i for i, c in enumerate("零一二三四五六七八九")} | {"〇": 0, "两": 2}
_UNITS = {"十": 10, "百": 100, "千": 1000, "万": 10000}


def ordinal(text: str) -> int | None:
    """The value of a short numeral, Chinese or in digits, or None."""
    if text.isdigit() and text.isascii():
        return int(text)
    total, digit = 0, None
    for c in text:
        if c in _UNITS:
            total += (1 if digit is None else digit) * _UNITS[c]
            digit = None
        elif c in _VALUES:
            if digit is not None:
                return None
            digit = _VALUES[c]
        else:
            return None
    return total + (digit or 0)


@dataclass
class Item:
    title: str | None
    part: str | None
    lines: list[str] = field(default_factory=list)


class Broken(ValueError):
    """A number that does not follow the one before."""


def lines_of(text: str) -> list[str]:
    cleaned = (_BLANKS.sub(" ", _UNSEEN.sub("", x.strip().lstrip("#"))).strip() for x in _LINES.split(text))
    return [x for x in cleaned if x and not CONTENTS.search(x)]


def _section(line: str) -> tuple[int | None, str, str] | None:
    """(number, mark, rest) of a line with a section's mark."""
    m = MARK.match(line)
    return (ordinal(m[1]), f"{m[1]}、", m[2].strip()) if m else None


def _item(line: str) -> tuple[int, str, str] | None:
    m = ITEM.match(line)
    if not m or REFERS.match(m[2]) or (n := ordinal(m[1])) is None:
        return None
    return n, f"（{m[1]}）", m[2].strip()


class _Parts:
    """Headings of books, chapters and sections; one clears those below it."""

    def __init__(self) -> None:
        self.held: dict[int, str] = {}

    def take(self, line: str) -> str | None:
        m = STRUCTURE.match(line)
        if not m:
            return None
        level = -1 if m[2] else LEVELS.index(m[1])
        self.held = {k: v for k, v in self.held.items() if 0 <= k < level} if level >= 0 else {}
        self.held[level] = line
        return " ".join(self.held[k] for k in sorted(self.held))


def flat(lines: list[str]) -> tuple[list[str], list[Item]]:
    before, items = [], []
    for line in lines:
        if mark := _section(line):
            if mark[0] != len(items) + 1:
                raise Broken(f"expected {len(items) + 1}: {line[:40]}")
            items.append(Item(mark[1], None, [mark[2]] if mark[2] else []))
        else:
            (items[-1].lines if items else before).append(line)
    return before, items


def sections(lines: list[str]) -> tuple[list[str], list[Item]]:
    before, items, parts, due = [], [], _Parts(), 1
    for line in lines:
        mark = _section(line)
        if mark and mark[0] == due:
            items.append(Item(line, line))
            due += 1
        elif not mark and (part := parts.take(line)):
            items.append(Item(line, part))
            due = 1
        else:
            (items[-1].lines if items else before).append(line)
    return before, [x for x in items if x.lines]


def nested(lines: list[str]) -> tuple[list[str], list[Item]]:
    before: list[str] = []
    items: list[Item] = []
    parts, part, heading = _Parts(), None, None
    lead: list[str] = []  # lines between a heading and its first item
    leads = False  # whether the last mark was a heading
    due_section = due_item = 1
    begun = 0  # items before the section

    def settle() -> None:
        """A section that ends without an item is one by its lines, or by its own line where that is a sentence."""
        nonlocal lead
        if lead:
            items.append(Item(None, part, lead))
            lead = []
        elif heading and len(items) == begun and "。" in heading:
            mark = _section(heading)
            items.append(Item(mark[1], None, [mark[2]]))

    for line in lines:
        mark = _section(line)
        found = None if mark else _item(line)
        structure = None if mark else parts.take(line)
        if mark and mark[0] == due_section or structure:
            settle()
            heading, begun, leads = (line if mark else None), len(items), True
            part, due_section, due_item = (line, due_section + 1, 1) if mark else (structure, 1, 1)
        elif found:
            if found[0] != due_item:
                raise Broken(f"expected {due_item}: {line[:40]}")
            items.append(Item(found[1], part, [*lead, *([found[2]] if found[2] else [])]))
            lead, leads, due_item = [], False, due_item + 1
        elif leads:
            lead.append(line)
        else:
            (items[-1].lines if items else before).append(line)
    settle()
    return before, items


def outline(text: str, least: int = 2) -> tuple[list[tuple], str | None]:
    """Rows (position, number, number_display, title, text, part) of a text's outline, and its issue if it has one."""
    lines = lines_of(text)
    marks = [x for x in lines if MARK.match(x)]
    n_items = sum(_item(x) is not None for x in lines)
    sentences = any(len(x) > HEADING_MOST or SENTENCE.search(x) for x in marks)
    form = flat if sentences and n_items <= len(marks) else nested if n_items else sections
    try:
        before, items = form(lines)
    except Broken as e:
        return [], f"sequence_broken: {e}"
    if len(items) < least:
        return [], None
    if empty := [i for i, x in enumerate(items, 1) if not x.lines]:
        return [], f"empty_text: {empty[0]}"
    rows = [(1, PREAMBLE, PREAMBLE, None, "\n".join(before), None)] if before else []
    shift = len(rows)
    return rows + [(i + shift, str(i), f"第{i}项", x.title, "\n".join(x.lines), x.part) for i, x in enumerate(items, 1)], None


def outline_items(docs: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, position, number, number_display, title, text, part, issue of the outlines of docs (doc, text); null texts have none."""
    names = [doc, "position", "number", "number_display", "title", "text", "part", "issue"]
    kinds = [pa.int32(), *[pa.string()] * 6]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch, own, rows = whole.slice(at, 256), [], []
                for i, text in enumerate(batch.column(1).to_pylist()):
                    found, issue = outline(text or "")
                    found = [(*r, None) for r in found] or ([(1, None, None, None, None, None, issue)] if issue else [])
                    own += [i] * len(found)
                    rows += found
                cols = list(zip(*rows, strict=True)) or [()] * 7
                yield pa.record_batch([batch.column(0).take(pa.array(own, pa.int64())), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names)

    kind = docs.schema[doc].dataType.simpleString()
    return docs.select(doc, "text").mapInArrow(run, f"`{doc}` {kind}, position int, number string, number_display string, title string, text string, part string, issue string")
