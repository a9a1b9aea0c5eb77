"""Lines of program code told from prose by their words and marks, learned without labels.

A naive Bayes mixture of two kinds of lines is fitted by expectation-maximisation: it starts from each line's
share of marks and from a few lines of code, and learns which words and marks stand in lines of code.

Defined results: blank lines are no lines; without lines of code in the texts the few given ones are all code
that is known.
"""

from __future__ import annotations

import re

import numpy as np

#: A few lines of program code, so that code is known where the tables hold none.
CODE_SEEDS = (
    "for (int i = 0; i < n; i++) { total += values[i]; }", "def area(width, height): return width * height", "while (node != NULL) { node = node->next; }",
    "const names = rows.map(r => r.name).filter(x => x.length > 3);", "import os; path = os.path.join(root, name); print(path)", "if (count >= limit) { break; } return count % 10;",
    "public static void main(String[] args) { System.out.println(args[0]); }", "SELECT name, count(*) FROM items WHERE price > 10 GROUP BY name;", "let x = items.reduce((a, b) => a + b, 0);",
    "#include <stdio.h>", "x = [i * 2 for i in range(10) if i % 3 == 0]", "class Point: pass", "try { run(); } catch (Exception e) { log(e); }", "var total = 0; total += sum(list);", "function add(a, b) { return a + b; }", "print(max(values), len(names))",
)
#: Rounds of the mixture, its smoothing, and the share of marks of a line it starts from.
CODE_ROUNDS = 6
CODE_SMOOTHING = 0.1
CODE_START = 0.08

MARKS = r"{}()\[\]<>=+*/&|#;_"
TOKEN = re.compile(rf"[^\W\d_぀-ヿ㐀-鿿]+(?:[ऀ-ॿ]+[^\W\d_぀-ヿ㐀-鿿]*)*|[.!?…।](?=\s)|[。！？\n]|[぀-ヿ㐀-鿿]+|[{MARKS}]+")
WIDE = re.compile(r"[぀-ヿ㐀-鿿]")
MARK = re.compile(rf"[{MARKS}]")
SENTENCE_END = set(".!?…।。！？")


def terms_of(text: str) -> list[str]:
    """Words, pairs of Chinese or Japanese characters, and runs of marks, with sentence ends and line feeds between."""
    found = TOKEN.findall(text.lower())
    if not text.isascii() and WIDE.search(text):
        found = [x for t in found for x in ([t[i : i + 2] for i in range(max(1, len(t) - 1))] if WIDE.match(t) else (t,))]
    return found


def learn_code(texts: list[str]) -> tuple[dict[str, float], float]:
    """Log odds of terms in lines of program code against prose, and of code itself."""
    lines = [x for t in texts for x in t.split("\n") if x.strip()]
    sure = len(lines)
    lines += CODE_SEEDS
    known: dict[str, int] = {}
    ids = [np.unique([known.setdefault(t, len(known)) for t in terms_of(x) if t not in SENTENCE_END]).astype(np.int64) for x in lines]
    owner, flat, v = np.repeat(np.arange(len(ids)), [len(x) for x in ids]), np.concatenate(ids), len(known)
    code = np.array([len(MARK.findall(x)) >= CODE_START * len(x) for x in lines], float)
    code[sure:] = 1.0
    for _ in range(CODE_ROUNDS):
        held = np.bincount(flat, code[owner], v), np.bincount(flat, 1 - code[owner], v)
        rates = [(n + CODE_SMOOTHING) / (n.sum() + CODE_SMOOTHING * v) for n in held]
        odds, prior = np.log(rates[0] / rates[1]), np.log((code.sum() + 1) / (len(code) - code.sum() + 1))
        code = 1 / (1 + np.exp(-np.clip(prior + np.bincount(owner, odds[flat], len(ids)), -30, 30)))
        code[sure:] = 1.0
    return {t: float(odds[i]) for t, i in known.items() if MARK.match(t) or abs(odds[i]) > 0.1}, float(prior)


def is_code(line: str, code: tuple[dict[str, float], float]) -> bool:
    """Whether a line is program code, by what :func:`learn_code` gave."""
    odds, prior = code
    return prior + sum(odds.get(t, 0.0) for t in set(terms_of(line))) > 0
