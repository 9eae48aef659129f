"""License scan: Aho-Corasick over the words of a text, and a shunting-yard parser for licence expressions.

One automaton finds the base phrases, further notice phrases and the identifier tags in one pass
over the words (runs of ASCII letters and digits and all other characters from U+0080 on, A-Z
lower-cased).  Where a tag such as ``SPDX-License-Identifier:`` stands, the rest of its line is read as an
expression of identifiers, ``and``, ``or``, ``with`` and parentheses.  Identifiers are held against a list, a parameter; a word that
is none is reported as unknown and is no label.

Score: how freely the text may be reused, 0 (no licence found, or reserved) to 1.  Each licence has a
grade; ``or`` takes the larger, ``and`` the smaller, ``with`` (an exception) the middle of the
licence's grade and 1; several findings in one text hold together, as by ``and``.  An unknown word
grants nothing: its grade is 0.

Defined results: null or empty texts have no words, no places, empty labels and score 0; a malformed
expression yields the known identifiers up to the fault and their smallest grade; an expression of unknown words alone finds no licence;
null ids are kept; rows are judged one by one,
so repeated rows repeat; only id and text are read.
"""

from __future__ import annotations

import re
from collections.abc import Collection

from pyspark.sql import DataFrame

from renewcast.llm.common import per_text

# The base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Further notices, as words, and their labels.
NOTICES = {
    "gnu general public license version 2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "apache license version 2 0": "apache-2.0",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc0": "cc0",
    "creative commons attribution": "cc-by",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
    "isc license": "isc",
    "public domain": "public-domain",
    "all rights reserved": "reserved",
}
#: Identifiers known without a list of one's own, in lower case: those of the licences above and the most used others.
IDENTIFIERS = (
    "0bsd", "afl-3.0", "agpl-3.0", "agpl-3.0-only", "agpl-3.0-or-later", "apache-1.1", "apache-2.0", "apsl-2.0", "artistic-2.0", "blueoak-1.0.0",
    "bsd-1-clause", "bsd-2-clause", "bsd-2-clause-patent", "bsd-3-clause", "bsd-3-clause-clear", "bsd-4-clause", "bsl-1.0", "bzip2-1.0.6",
    "cc-by-3.0", "cc-by-4.0", "cc-by-nc-4.0", "cc-by-nc-nd-4.0", "cc-by-nc-sa-4.0", "cc-by-nd-4.0", "cc-by-sa-3.0", "cc-by-sa-4.0", "cc0-1.0",
    "cddl-1.0", "cddl-1.1", "cecill-2.1", "cpl-1.0", "ecl-2.0", "epl-1.0", "epl-2.0", "eupl-1.1", "eupl-1.2", "gfdl-1.3", "gpl-1.0", "gpl-2.0",
    "gpl-2.0-only", "gpl-2.0-or-later", "gpl-3.0", "gpl-3.0-only", "gpl-3.0-or-later", "hpnd", "ijg", "isc", "lgpl-2.0", "lgpl-2.1",
    "lgpl-2.1-only", "lgpl-2.1-or-later", "lgpl-3.0", "lgpl-3.0-only", "lgpl-3.0-or-later", "libpng-2.0", "lppl-1.3c", "mit", "mit-0", "mpl-1.1",
    "mpl-2.0", "ms-pl", "ms-rl", "mulanpsl-2.0", "ncsa", "odbl-1.0", "ofl-1.1", "openssl", "osl-3.0", "pddl-1.0", "php-3.01", "postgresql",
    "proprietary", "psf-2.0", "python-2.0", "qpl-1.0", "ruby", "sspl-1.0", "tcl", "unicode-3.0", "unlicense", "upl-1.0", "vim", "w3c", "wtfpl", "x11",
    "zlib", "zpl-2.1",
    # after "with"
    "autoconf-exception-3.0", "bison-exception-2.2", "classpath-exception-2.0", "gcc-exception-3.1", "linux-syscall-note", "llvm-exception",
    "openssl-exception", "font-exception-2.0", "libtool-exception", "swift-exception", "u-boot-exception-2.0", "wxwindows-exception-3.1",
)
#: References that a document defines itself.
OWN = ("licenseref-", "documentref-")
TAGS = ("spdx license identifier", "license expression")
TAG_LINE = re.compile(rb"(?:spdx-license-identifier|license-expression)[ \t]*[:=][ \t]*([^\n\r]*)")
#: Grade by the first part of a label; others are 0.5.
GRADES = {
    "mit": 1.0, "apache": 1.0, "bsd": 1.0, "isc": 1.0, "cc0": 1.0, "public": 1.0, "0bsd": 1.0, "unlicense": 1.0, "zlib": 1.0,
    "cc": 0.8, "mpl": 0.6, "epl": 0.6, "lgpl": 0.6, "gpl": 0.3, "agpl": 0.2, "reserved": 0.0, "proprietary": 0.0,
}
UNKNOWN = 0.5
OPERATORS = {"or": 1, "and": 2, "with": 3}
NOT_WORD = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))


def grade(label: str) -> float:
    if "-nc" in label or "-nd" in label:
        return 0.1
    return GRADES.get(label.split("-")[0], UNKNOWN)


def postfix(expression: str) -> list[str]:
    """Shunting-yard: infix tokens to postfix order; stops at the first token that cannot follow."""
    out: list[str] = []
    held: list[str] = []
    operand = True                       # whether an identifier or "(" is due
    for t in re.findall(r"[()]|[a-z0-9.+:-]+", expression):
        if t in OPERATORS:
            if operand:
                break
            while held and held[-1] != "(" and OPERATORS[held[-1]] >= OPERATORS[t]:
                out.append(held.pop())
            held.append(t)
            operand = True
        elif t == "(":
            if not operand:
                break
            held.append(t)
        elif t == ")":
            if operand or "(" not in held:
                break
            while held[-1] != "(":
                out.append(held.pop())
            held.pop()
        else:
            if not operand:
                break
            out.append(t)
            operand = False
    while held:
        if (t := held.pop()) != "(":
            out.append(t)
    return out


def evaluate(expression: str, known: Collection[str] = IDENTIFIERS) -> tuple[set[str], float, set[str]] | None:
    """(labels, grade, unknown words) of an expression; None if it names nothing.  A ``+`` behind an identifier is not part of it."""
    stack: list[tuple[set[str], float, set[str]]] = []
    seen: list[tuple[set[str], float, set[str]]] = []
    for t in postfix(expression):
        if t not in OPERATORS:
            name = t.rstrip("+")
            sure = name in known or name.startswith(OWN)
            stack.append(({name}, grade(t), set()) if sure else (set(), 0.0, {name}))
            seen.append(stack[-1])
            continue
        if len(stack) < 2:               # cut off after an operator
            break
        b, a = stack.pop(), stack.pop()
        if t == "with":
            stack.append((a[0] | {f"with-{x}" for x in b[0]}, (a[1] + 1) / 2 if a[0] else 0.0, a[2] | b[2]))
        else:
            stack.append((a[0] | b[0], max(a[1], b[1]) if t == "or" else min(a[1], b[1]), a[2] | b[2]))
    if len(stack) == 1:
        return stack[0]
    sure = [x for x in seen if x[0]]
    return (set().union(*[x[0] for x in seen]), min((x[1] for x in sure), default=0.0), set().union(*[x[2] for x in seen])) if seen else None


def scanner(known: Collection[str] = IDENTIFIERS):
    """The function text -> (n_words, n_base, first_word, last_word, base_labels, labels, score, unknown)."""
    import ahocorasick

    known = frozenset(x.lower() for x in known)

    found = ahocorasick.Automaton()
    for phrase in {*BASE, *NOTICES, *TAGS}:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()

    def scan(text: str) -> tuple:
        low = text.encode("utf-8", "replace").lower()      # bytes.lower folds A-Z alone
        words = low.translate(NOT_WORD).split(b" ")
        words = [w for w in words if w]
        line = " " + b" ".join(words).decode("latin-1") + " "
        starts, base, more, other, tagged = [], set(), set(), set(), False
        for end, phrase in found.iter(line):
            if phrase in BASE:
                starts.append(end - len(phrase) - 1)
                base.add(BASE[phrase])
            if phrase in NOTICES:
                more.add(NOTICES[phrase])
            tagged |= phrase in TAGS
        grades = [grade(x) for x in base | more]
        if tagged:
            for m in TAG_LINE.finditer(low):
                if value := evaluate(m[1].decode("utf-8", "replace"), known):
                    more |= value[0]
                    other |= value[2]
                    if value[0]:
                        grades.append(value[1])
        first = line.count(" ", 0, min(starts)) if starts else None
        last = line.count(" ", 0, max(starts)) if starts else None
        return (len(words), len(starts), first, last, ",".join(sorted(base)), ",".join(sorted(base | more)),
                min(grades) if grades else 0.0, ",".join(sorted(other)))

    return scan


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", identifiers: Collection[str] = IDENTIFIERS) -> DataFrame:
    """One row per document; first_word and last_word are null without a place; unknown has the words in expressions that are no
    identifier."""
    return per_text(docs, id_col, text_col, lambda: scanner(identifiers), "n_words long, n_base long, first_word long, last_word long, "
                    "base_labels string, labels string, score double, unknown string")
