"""Licence scan: Aho-Corasick finds identifier tags and notice phrases, a shunting-yard parser reads expressions.

All phrases go into one automaton that runs once over each normalised text, so cost does not grow
with the number of phrases. Identifier tags lead to the expression that follows them, which is evaluated with
``with`` binding tightest, then ``and``, then ``or``.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timbrel.llm.common import arrow_map, utf8

c = F.col

# Notice phrases as words, and the label of each.
BASE = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
NOTICES = {
    "apache license version 2 0": "apache-2.0",
    "apache license": "apache",
    "mit license": "mit",
    "bsd license": "bsd",
    "mozilla public license": "mpl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "general public license version 2": "gpl-2.0",
    "general public license version 3": "gpl-3.0",
    "creative commons attribution": "cc-by",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0 1 0": "cc0",
    "public domain": "public-domain",
    "the unlicense": "unlicense",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
}
TAGS = {"spdx license identifier": "tag", "license expression": "tag"}
PRECEDENCE = {"or": 1, "and": 2, "with": 3}
# how free a label leaves the reader: 1 permissive, 0 reserved; others lie between
FREEDOM = {"reserved": 0.0, "cc-by-nc": 0.3, "cc-by-nd": 0.3, "gpl": 0.6, "agpl": 0.5, "lgpl": 0.7, "mpl": 0.7}
# Names of public licences; a version, "+", "-only" or "-or-later" may follow.
NAMES = frozenset("""
    0bsd aal afl agpl apache apsl artistic beerware bittorrent blessing blueoak bsd bsl cc-by cc-by-nc cc-by-nc-nd cc-by-nc-sa
    cc-by-nd cc-by-sa cc0 cddl cecill cecill-b cecill-c cpl curl ecl efl epl eupl fsfap ftl gfdl gpl hpnd icu ijg imagemagick
    intel ipl isc lgpl libpng libtiff lppl mit mpl ms-pl ms-rl mulanpsl naist ncsa nposl odbl odc-by ofl openssl osl pddl php
    postgresql psf python qpl ruby sgi-b sissl sleepycat spl tcl unicode unicode-dfs unlicense upl vim w3c wtfpl x11 zlib zpl
""".split())
_VERSION = re.compile(r"-[0-9][a-z0-9.-]*$")
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256))
_TAG = re.compile(
    rb"(?<![0-9a-z\x80-\xff])(?:spdx[^0-9a-z\x80-\xff]+license[^0-9a-z\x80-\xff]+identifier|license[^0-9a-z\x80-\xff]+expression)"
    rb"(?![0-9a-z\x80-\xff])[^0-9a-z\x80-\xff\n(]*")
_PART = re.compile(r"[()]|[a-z0-9][a-z0-9.+:-]*")
_PART_BYTES = re.compile(_PART.pattern.encode())


def postfix(expression: str) -> list[str]:
    """Shunting-yard: the expression in postfix order; empty if it is malformed or ends early."""
    return _postfix(_PART.findall(expression.lower()))


def _postfix(parts: Iterable[str]) -> list[str]:
    """Reads ``parts`` only as far as the expression goes."""
    out, ops, operand_next = [], [], True
    for part in parts:
        if part == "(":
            if not operand_next:
                break
            ops.append(part)
        elif part == ")":
            if operand_next or "(" not in ops:
                break
            while ops[-1] != "(":
                out.append(ops.pop())
            ops.pop()
        elif part in PRECEDENCE:
            if operand_next:
                return []
            while ops and ops[-1] != "(" and PRECEDENCE[ops[-1]] >= PRECEDENCE[part]:
                out.append(ops.pop())
            ops.append(part)
            operand_next = True
        else:
            if not operand_next:  # prose begins
                break
            out.append(part.rstrip(".:-"))
            operand_next = False
    if operand_next or "(" in ops:
        return []
    return out + ops[::-1]


def longest(parts: Iterable[str]) -> tuple[list[str], bool]:
    """The longest well-formed beginning in postfix order, and whether the expression runs into prose."""
    kept, good, depth, operand_next = [], 0, 0, True
    for part in parts:
        if part == "(":
            if not operand_next:
                break
            depth += 1
        elif part == ")":
            if operand_next or not depth:
                break
            depth -= 1
        elif part in PRECEDENCE:
            if operand_next:
                break
            operand_next = True
        elif operand_next:
            operand_next = False
        else:
            return _postfix(kept[:good]), True
        kept.append(part)
        if not operand_next and not depth:
            good = len(kept)
    return _postfix(kept[:good]), False


def evaluate(expression: str) -> tuple[frozenset[str], float] | None:
    """The licences an expression names and how free it leaves the reader: ``or`` lets one choose the freest,
    ``and`` binds to all, ``with`` adds an exception to its licence. None if it is malformed."""
    return _value(postfix(expression))


def _value(parts: list[str]) -> tuple[frozenset[str], float] | None:
    stack: list[tuple[frozenset[str], float]] = []
    for part in parts:
        if part not in PRECEDENCE:
            stack.append((frozenset([part]), freedom(part)))
            continue
        (right, b), (left, a) = stack.pop(), stack.pop()
        if part == "with":
            eased = min(1.0, a + 0.1) if a else a
            stack.append((frozenset(f"{x}-with-{y}" for x in left for y in right), eased))
        else:
            stack.append((left | right, max(a, b) if part == "or" else min(a, b)))
    return stack[0] if stack else None


def listed(name: str) -> bool:
    """Whether ``name`` is a public licence, of any version."""
    name = name.rstrip("+").removesuffix("-only").removesuffix("-or-later")
    return name in NAMES or _VERSION.sub("", name) in NAMES


def freedom(label: str) -> float:
    """What is not listed is as strict as reserved rights, references to own terms too."""
    known = [k for k in FREEDOM if label == k or label.startswith(k + "-")]
    if known:
        return FREEDOM[max(known, key=len)]
    return 1.0 if label in NOTICES.values() or listed(label) else 0.0


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for phrase in BASE | NOTICES | TAGS:
        made.add_word(f" {phrase} ", phrase)
    made.make_automaton()
    return made


def _expressions(low: bytes) -> Iterator[list[str]]:
    """What follows each tag, in postfix order: up to prose, the end of the line or the next tag. Unlisted names that
    run into prose are prose themselves."""
    tags = list(_TAG.finditer(low))
    for tag, following in zip(tags, [*(m.start() for m in tags[1:]), len(low)]):
        line = low.find(b"\n", tag.end(), following)
        parts = _PART_BYTES.finditer(low, tag.end(), following if line < 0 else line)
        found, prose = longest(m[0].decode() for m in parts)
        if not prose or any(map(listed, found)):
            yield found


def scan(data: bytes) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, expressions of one text."""
    words = data.translate(_FOLD).split()
    line = (b" " + b" ".join(words) + b" ").decode("latin-1")
    starts, base, labels, tagged = [], set(), set(), False
    for end, phrase in automaton().iter(line):
        if phrase in TAGS:
            tagged = True
            continue
        if phrase in BASE:
            starts.append(end - len(phrase) - 1)
            base.add(BASE[phrase])
        else:
            labels.add(NOTICES[phrase])
    labels |= base
    values, found = [*map(freedom, labels)], []
    if tagged:
        for parts in _expressions(data.lower()):
            value = _value(parts)
            if value:
                labels |= value[0]
                values.append(value[1])
                found.append(" ".join(parts))
    score = min(values, default=0.5)
    at = [line.count(" ", 0, x) for x in (min(starts), max(starts))] if starts else [None, None]
    return len(words), len(starts), *at, ",".join(sorted(base)), ",".join(sorted(labels)), float(score), found


FIELDS = ("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
          "score double, expressions array<string>")


def licences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, expressions per row.

    Words are runs of digits, letters a-z (after lower-casing A-Z) and non-ASCII characters of the whole
    text. Base places all count, overlapping ones and repetitions too; first_word and last_word are the
    least and largest start, null without any. ``labels`` holds the base labels, those of notices and
    those of expressions after identifier tags, in postfix form in ``expressions``: the longest well-formed beginning counts, and
    names that are in no list stand for reserved rights. ``score`` is the freedom of the strictest notice or expression, 0.5
    without any. Null counts as empty; no rows give none; repeated rows each get a row; texts are read whole; other columns
    are not looked at, whatever their names.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.string())]
    names = ["doc_id", *(x.split()[0] for x in FIELDS.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = list(zip(*map(scan, b[1].to_pylist()))) or [[]] * len(types)
            yield pa.RecordBatch.from_arrays([b[0], *(pa.array(x, t) for x, t in zip(found, types))], names=names)

    rows = docs.select(c(doc_id).alias("doc_id"), utf8(c(text)).alias("text"))
    return arrow_map(rows, run, f"doc_id {kind}, {FIELDS}")
