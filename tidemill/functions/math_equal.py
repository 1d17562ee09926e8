"""Whether two final answers in maths mean the same: normal forms, values of closed expressions, percentages, identities of
expressions with unknowns (see ``identities``), and tuples, intervals and matrices element by element."""

from __future__ import annotations

import math
import re

from tidemill.functions.identities import identical
from tidemill.functions.text import last_box, plain_latex

# Marks before and after an answer in a response, and the tolerance of numbers.
BEFORE_ANSWER = ("answer:", "answer is", "answers are")
AFTER_ANSWER = ("is answer", "is the answer", "are answers", "are the answers")
BEFORE_VALUE = ("be ", "is ", "are ", "=", ": ", "get ", "be\n", "is\n", "are\n", ":\n", "get\n")
TOLERANCE = 1e-4
PIS = (math.pi, 3.14)

_TOKEN = re.compile(r"\s*(?:(?P<number>\d+(?:,\d{3})+(?:\.\d+)?|\d*\.?\d+)|(?P<word>\\[a-zA-Z]+)|(?P<sign>[-+*/^(){}]))")
_WRAPPED = re.compile(r"\\(?:text|textbf|mathrm|mbox)\{([^{}]*)\}")
_MATRIX = re.compile(r"\\begin\{([pb]?matrix)\}(.*)\\end\{\1\}", re.DOTALL)


class _Value:
    """The value of a closed expression by recursive descent; whatever isn't one raises ValueError."""

    def __init__(self, text: str, pi: float):
        self.pi, self.at, self.tokens = pi, 0, []
        while text.strip():
            m = _TOKEN.match(text)
            if not m:
                raise ValueError(text)
            self.tokens.append(m.group().strip())
            text = text[m.end() :]

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self, wanted: str | None = None) -> str:
        token = self.peek()
        if not token or (wanted is not None and token != wanted):
            raise ValueError(token)
        self.at += 1
        return token

    def whole(self) -> float:
        found = self.total()
        if self.peek():
            raise ValueError(self.peek())
        return found

    def total(self) -> float:
        found = self.product()
        while self.peek() in ("+", "-"):
            found += self.product() if self.take() == "+" else -self.product()
        return found

    def product(self) -> float:
        found = self.signed()
        while token := self.peek():
            if token in ("*", "/", "\\cdot", "\\times", "\\div"):
                self.take()
                other = self.signed()
                found = found / other if token in ("/", "\\div") else found * other
            elif token in ("(", "{") or token in ("\\pi", "\\sqrt", "\\frac"):
                found *= self.power()  # factors side by side
            else:
                break
        return found

    def signed(self) -> float:
        if self.peek() in ("+", "-"):
            return -self.signed() if self.take() == "-" else self.signed()
        return self.power()

    def power(self) -> float:
        found = self.atom()
        if self.peek() == "^":
            self.take()
            found = found ** self.signed()
            if isinstance(found, complex):
                raise ValueError("not a real number")
        return found

    def group(self) -> float:
        self.take("{")
        found = self.total()
        self.take("}")
        return found

    def atom(self) -> float:
        token = self.take()
        if token in ("(", "{"):
            found = self.total()
            self.take(")" if token == "(" else "}")
            return found
        if token == "\\pi":
            return self.pi
        if token == "\\sqrt":
            return math.sqrt(self.group())
        if token == "\\frac":
            return self.group() / self.group()
        return float(token.replace(",", ""))


def value(text: str, pi: float = math.pi) -> float | None:
    """The value of a number or closed expression; of ``digits_base`` the digits; None for anything else."""
    text = text.strip().lstrip("$").rstrip("$").replace("{,}", ",").removesuffix("\\%").removesuffix("%")
    digits, mark, base = text.partition("_")
    if mark and re.fullmatch(r"\{?\d+\}?", base):
        text = digits
    try:
        return _Value(plain_latex(text), pi).whole()
    except (ValueError, ArithmeticError, IndexError, RecursionError):
        return None


def _close(a: float, b: float) -> bool:
    """Near each other, where either may be meant in percent."""
    return any(math.isclose(a, b * scale, rel_tol=TOLERANCE) for scale in (0.01, 1, 100))


def _parts(text: str) -> list[str]:
    """At commas outside of brackets; whole numbers with commas were compared before."""
    out, depth, start = [], 0, 0
    for k, c in enumerate(text):
        depth += {"(": 1, "[": 1, "{": 1, ")": -1, "]": -1, "}": -1}.get(c, 0)
        if c == "," and depth <= 0:
            out.append(text[start:k])
            start = k + 1
    return [*out, text[start:]]


def _rows(text: str) -> list[list[str]] | None:
    """The entries of a matrix, in LaTeX or as nested lists."""
    m = _MATRIX.search(text)
    if m:
        return [[x.strip() for x in row.split("&")] for row in re.split(r"\\\\", m[2]) if row.strip()]
    if text.startswith("[[") and text.endswith("]]"):
        return [[x.strip() for x in _parts(row.strip()[1:-1])] for row in _parts(text[1:-1])]
    return None


def _normal(text: str) -> str:
    text = _WRAPPED.sub(r"\1", text.strip().strip("$"))
    try:
        return plain_latex(text).lower()
    except (ValueError, IndexError):
        return text.replace(" ", "").lower()


def same_answer(given: str | None, truth: str | None) -> bool:
    """Whether a given answer means the true one."""
    if given is None or truth is None:
        return False
    given, truth = given.strip(), truth.strip()
    if given == truth or (given and _normal(given) == _normal(truth)):
        return True
    matrices = _rows(given), _rows(truth)
    if all(matrices):
        a, b = matrices
        return [len(r) for r in a] == [len(r) for r in b] and all(same_answer(x, y) for r, s in zip(a, b, strict=True) for x, y in zip(r, s, strict=True))
    for pi in PIS if "\\pi" in given + truth else PIS[:1]:
        a, b = value(given, pi), value(truth, pi)
        if a is not None and b is not None and _close(a, b):
            return True
    if identical(given, truth):
        return True
    a, b = (t.replace("\\left", "").replace("\\right", "").strip() for t in (given, truth))
    bracketed = [t[:1] in ("(", "[") and t[-1:] in (")", "]") for t in (a, b)]
    if all(bracketed) and (a[0], a[-1]) == (b[0], b[-1]):
        a, b = a[1:-1], b[1:-1]
    elif any(bracketed):
        return False
    xs, ys = _parts(a), _parts(b)
    return len(xs) == len(ys) > 1 and all(same_answer(x, y) for x, y in zip(xs, ys, strict=True))


_SET = re.compile(r"^\\?\{(.*?)\\?\}$", re.DOTALL)
_INLINE = re.compile(r"\$\$(.+?)\$\$|\$(.+?)\$|\\\((.+?)\\\)|\\\[(.+?)\\\]", re.DOTALL)
_NUMBER = re.compile(r"(?<![\w.])[-+]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?(?:/\d+)?%?")


def _members(text: str) -> list[str] | None:
    """The members of a set in braces."""
    m = _SET.match(text.replace("\\left", "").replace("\\right", "").strip().strip("$").strip())
    return [x.strip() for x in _parts(m[1])] if m else None


def verified(given: str | None, truth: str | None) -> bool:
    """``same_answer``, and sets in braces without regard to order or repeats."""
    if given is None or truth is None:
        return False
    sets = _members(given), _members(truth)
    if all(x is not None for x in sets):
        return all(any(same_answer(x, y) for y in b) for a, b in (sets, sets[::-1]) for x in a)
    return same_answer(given, truth)


def extracted_answer(response: str) -> str | None:
    """The last box of a response, else its last formula between dollars or LaTeX brackets, else its last number."""
    found = last_box(response)
    if found is not None:
        return found.strip()
    formulas = [next(g for g in m.groups() if g is not None) for m in _INLINE.finditer(response)]
    if formulas:
        return formulas[-1].strip()
    numbers = _NUMBER.findall(response)
    return numbers[-1] if numbers else None


def stated_answer(response: str) -> str:
    """The answer that a response states: after the last mark of an answer, before a mark that follows one, in the last box, without
    a further sentence, after the last word that leads to a value."""

    def after(text: str, marks: tuple[str, ...]) -> str:
        for mark in marks:
            _, found, rest = text.lower().rpartition(mark)
            if found:
                text = text[len(text) - len(rest) :].strip()
        return text

    text = after(response, BEFORE_ANSWER)
    for mark in AFTER_ANSWER:
        at = text.lower().rfind(mark)
        text = text[:at].strip() if at >= 0 else text
    text = (last_box(text) or "").strip() or text
    at = text.rfind(". ")
    return after(text[:at].strip() if at >= 0 else text, BEFORE_VALUE)
