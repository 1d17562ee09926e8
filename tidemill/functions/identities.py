"""Whether two expressions with unknowns are the same, by randomized identity testing.

Both are parsed to trees and evaluated at random points. Rational expressions are evaluated modulo large primes,
where a nonzero polynomial of degree d vanishes at a random point with probability of at most d / p (Schwartz and
Zippel). Transcendental constants are unknowns there and the imaginary unit is a root of -1, so that check is exact
but for that probability: with ``MAX_DEGREE``, three primes and two points each it is below 1e-60. Expressions with
roots, other real powers, logarithms or functions of angles are evaluated in floating point instead, at real points
of both signs; they are the same where they agree at every point at which both are real, of which there must be
``LEAST_POINTS``. Points are drawn from a seed made of the two texts, so reruns agree.

Texts of more than ``MAX_TOKENS`` tokens, deeper than ``MAX_DEPTH`` or of a higher degree, and texts that aren't
expressions (a run of three letters that names no function is a word) raise ValueError in ``parse`` and are never
the same as another in ``identical``.
"""

from __future__ import annotations

import math
import random
import re
from fractions import Fraction

MAX_TOKENS, MAX_DEPTH, MAX_DEGREE, MAX_DIGITS = 600, 60, 10**6, 50
#: The largest primes below 2**61, 2**62 and 2**63 that are 1 modulo 4, so that -1 has a root.
PRIMES = ((1 << 61) - 31, (1 << 62) - 87, (1 << 63) - 259)
POINTS, TRIES, LEAST_POINTS, NEAR = 2, 40, 6, 1e-7

FUNCTIONS = {
    "sin": math.sin, "cos": math.cos, "tan": math.tan, "cot": lambda x: 1 / math.tan(x), "sec": lambda x: 1 / math.cos(x), "csc": lambda x: 1 / math.sin(x),
    "arcsin": math.asin, "arccos": math.acos, "arctan": math.atan, "sinh": math.sinh, "cosh": math.cosh, "tanh": math.tanh, "ln": math.log, "log": math.log10, "exp": math.exp, "abs": abs,
}
CLOSES = {"(": ")", "[": "]", "{": "}"}
CONSTANTS = {"pi": math.pi, "e": math.e}
SIGNS = {"\\cdot": "*", "\\times": "*", "\\ast": "*", "\\div": "/", "**": "^", "×": "*", "·": "*", "÷": "/", "−": "-", "–": "-", "\\lbrack": "[", "\\rbrack": "]", "\\vert": "|"}
GREEK = frozenset(("alpha", "beta", "gamma", "delta", "epsilon", "theta", "lambda", "mu", "phi", "rho", "sigma", "tau", "omega", "pi"))

_SKIP = re.compile(r"\\(?:left|right|displaystyle|quad|qquad)(?![a-zA-Z])|\\[,;:! ]|[$~]")
_FLAT = re.compile(r"\\[dtc]frac(?![a-zA-Z])")
_TEXT = re.compile(r"\\(?:mathrm|operatorname|text|mathbf|mathit)\{([^{}]*)\}")
_TOKEN = re.compile(r"(?P<number>\d{1,3}(?:,\d{3})+(?!\d)(?:\.\d+)?|\d+\.?\d*|\.\d+)|(?P<command>\\[a-zA-Z]+)|(?P<word>[a-zA-Z]+)|(?P<sign>\*\*|[-+*/^(){}\[\]|!_×·÷−–π√])")
_WORDS = sorted([*FUNCTIONS, "sqrt", "pi"], key=len, reverse=True)


class Parser:
    """A tree of tuples: ("n", Fraction), ("x", name), ("+", a, b), ("*", a, b), ("/", a, b), ("^", a, b), ("f", name, a), ("root", a, n)."""

    def __init__(self, text: str):
        text = _SKIP.sub(" ", _TEXT.sub(r"\1", _FLAT.sub(r"\\frac", text))).rstrip(" .,;")
        self.tokens, self.at, self.depth = self._tokens(text), 0, 0
        if not self.tokens:
            raise ValueError("empty")

    @staticmethod
    def _tokens(text: str) -> list[str]:
        out, at, bracketed = [], 0, any(c in text for c in "([{")
        while at < len(text):
            if text[at].isspace():
                at += 1
                continue
            m = _TOKEN.match(text, at)
            if not m or len(out) > MAX_TOKENS:
                raise ValueError(text[:50])
            token = m.group()
            at = m.end()
            if m["number"]:
                if len(token) > MAX_DIGITS or (bracketed and "," in token):
                    raise ValueError("too many digits, or a comma that may part elements")
                out.append(token)
            elif m["word"]:
                out += Parser._names(token)
            else:
                out.append({"π": "\\pi", "√": "\\sqrt"}.get(token) or SIGNS.get(token, token))
        return out

    @staticmethod
    def _names(word: str) -> list[str]:
        """Function names in a run of letters, and single letters; three letters together that name nothing are a word."""
        out, loose = [], 0
        while word:
            known = next((w for w in _WORDS if word.startswith(w)), None)
            loose = 0 if known else loose + 1
            if loose > 2:
                raise ValueError(word)
            out.append("\\" + known if known else word[0])
            word = word[len(known or word[0]) :]
        return out

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self, wanted: str | None = None) -> str:
        token = self.peek()
        if not token or (wanted is not None and token != wanted):
            raise ValueError(f"{token!r} for {wanted!r}")
        self.at += 1
        return token

    def whole(self) -> tuple:
        found = self.total()
        if self.peek():
            raise ValueError(self.peek())
        return found

    def total(self) -> tuple:
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise ValueError("too deep")
        found = self.product()
        while self.peek() in ("+", "-"):
            sign, other = self.take(), self.product()
            found = ("+", found, other if sign == "+" else _negative(other))
        self.depth -= 1
        return found

    def product(self) -> tuple:
        found = self.signed()
        while token := self.peek():
            if token in ("*", "/"):
                found = (self.take(), found, self.signed())
            elif token in CLOSES or token[0].isalnum() or (token[0] == "\\" and self._opens(token[1:])):
                found = ("*", found, self.power())
            else:
                break
        return found

    @staticmethod
    def _opens(command: str) -> bool:
        return command in FUNCTIONS or command in GREEK or command in ("frac", "sqrt")

    def signed(self) -> tuple:
        if self.peek() in ("+", "-"):
            self.depth += 1
            if self.depth > MAX_DEPTH:
                raise ValueError("too deep")
            found = self.signed() if self.take() == "+" else _negative(self.signed())
            self.depth -= 1
            return found
        return self.power()

    def power(self) -> tuple:
        found = self.atom()
        while self.peek() == "!":
            self.take()
            n = constant(found)
            if n is None or n.denominator != 1 or not 0 <= n <= 30:
                raise ValueError("a factorial of no small number")
            found = ("n", Fraction(math.factorial(int(n))))
        if self.peek() == "^":
            self.take()
            self.depth += 1
            if self.depth > MAX_DEPTH:
                raise ValueError("too deep")
            found = ("^", found, self.argument() if self.peek() == "{" else self.signed())
            self.depth -= 1
        return found

    def argument(self) -> tuple:
        """A group in braces, or a digit, letter or command by itself, as LaTeX has it."""
        token = self.take()
        if token == "{":
            found = self.total()
            self.take("}")
            return found
        if token[0].isdigit():
            if len(token) > 1:
                self.at -= 1
                self.tokens[self.at] = token[1:]
            return ("n", Fraction(token[0]))
        self.at -= 1
        return self.atom()

    def atom(self) -> tuple:
        token = self.take()
        if token in CLOSES:
            found = self.total()
            self.take(CLOSES[token])
            return found
        if token == "|":
            found = self.total()
            self.take("|")
            return ("f", "abs", found)
        if token[0].isdigit() or token[0] == ".":
            return ("n", Fraction(token.replace(",", "").rstrip(".")))
        if len(token) == 1 and token.isalpha():
            return self._named(token)
        command = token[1:]
        if token[0] == "\\" and command == "frac":
            above = self.argument()
            return ("/", above, self.argument())
        if token[0] == "\\" and command == "sqrt":
            if self.peek() == "[":
                self.take()
                order = self.total()
                self.take("]")
                return ("root", self.argument(), order)
            return ("root", self.argument(), ("n", Fraction(2)))
        if token[0] == "\\" and command in FUNCTIONS:
            return self._applied(command)
        if token[0] == "\\" and command in GREEK:
            return self._named(command)
        raise ValueError(token)

    def _named(self, name: str) -> tuple:
        if self.peek() == "_":
            self.take()
            if self.peek() == "{":
                self.take()
                inner = ""
                while self.peek() != "}":
                    inner += self.take()
                self.take("}")
            else:
                inner = self.take()
            name += "_" + inner
        return ("x", name)

    def _applied(self, name: str) -> tuple:
        base = order = None
        if self.peek() == "_":
            self.take()
            base = self.argument()
        if self.peek() == "^":
            self.take()
            order = self.argument()
        if self.peek() in ("(", "[", "{", "|"):
            found = self.atom()
        else:  # factors up to the next sign or function
            found = self.power()
            while (token := self.peek()) and (token[0].isalnum() or token[1:] in GREEK or token == "\\frac"):
                found = ("*", found, self.power())
        if name == "abs" and order is None and base is None:
            return ("f", "abs", found)
        found = ("/", ("f", "ln", found), ("f", "ln", base)) if base is not None else ("f", name, found)
        if order == _negative(("n", Fraction(1))):
            raise ValueError("an inverse function")
        return found if order is None else ("^", found, order)


def _negative(tree: tuple) -> tuple:
    return ("n", -tree[1]) if tree[0] == "n" else ("*", ("n", Fraction(-1)), tree)


def parse(text: str) -> tuple:
    return Parser(text).whole()


def constant(tree: tuple) -> Fraction | None:
    """The value of a tree of numbers alone, if it is a fraction of moderate size."""
    if tree[0] == "n":
        return tree[1]
    if tree[0] in ("x", "f", "root"):
        return None
    a, b = constant(tree[1]), constant(tree[2])
    if a is None or b is None or max(abs(x.numerator).bit_length() + x.denominator.bit_length() for x in (a, b)) > 4096:
        return None
    if tree[0] == "+":
        return a + b
    if tree[0] == "*":
        return a * b
    if tree[0] == "/":
        return a / b if b else None
    return a**b if b.denominator == 1 and abs(b) <= 64 and (a or b >= 0) else None


def names(tree: tuple) -> set[str]:
    if tree[0] == "x":
        return {tree[1]}
    return set().union(*[names(t) for t in tree[1:] if isinstance(t, tuple)])


def degree(tree: tuple) -> tuple[int, int] | None:
    """Bounds of the degrees of numerator and denominator; None for what isn't a rational expression."""
    kind = tree[0]
    if kind == "n":
        return 0, 0
    if kind == "x":
        return 1, 0
    if kind in ("f", "root"):
        return None
    a = degree(tree[1])
    if a is None:
        return None
    if kind == "^":
        n = constant(tree[2])
        if n is None or n.denominator != 1:
            return None
        high, low = a if n >= 0 else a[::-1]
        found = high * abs(int(n)), low * abs(int(n))
    else:
        b = degree(tree[2])
        if b is None:
            return None
        if kind == "+":
            found = max(a[0] + b[1], b[0] + a[1]), a[1] + b[1]
        else:
            found = (a[0] + b[0], a[1] + b[1]) if kind == "*" else (a[0] + b[1], a[1] + b[0])
    if max(found) > MAX_DEGREE:
        raise ValueError("too high a degree")
    return found


def modulo(tree: tuple, at: dict[str, int], p: int) -> int:
    """The value of a rational expression modulo a prime; ZeroDivisionError at a pole."""
    kind = tree[0]
    if kind == "n":
        return tree[1].numerator * _inverse(tree[1].denominator % p, p) % p
    if kind == "x":
        return at[tree[1]]
    a = modulo(tree[1], at, p)
    if kind == "^":
        n = int(constant(tree[2]))
        return pow(a if n >= 0 else _inverse(a, p), abs(n), p)
    b = modulo(tree[2], at, p)
    return (a + b if kind == "+" else a * b if kind == "*" else a * _inverse(b, p)) % p


def _inverse(a: int, p: int) -> int:
    if a % p == 0:
        raise ZeroDivisionError
    return pow(a, -1, p)


def real(tree: tuple, at: dict[str, float]) -> float:
    """The value of an expression at a real point; ValueError, OverflowError or ZeroDivisionError where it has none."""
    kind = tree[0]
    if kind == "n":
        return float(tree[1])
    if kind == "x":
        return at[tree[1]]
    if kind == "f":
        return FUNCTIONS[tree[1]](real(tree[2], at))
    a, b = real(tree[1], at), real(tree[2], at)
    if kind == "root":
        n = constant(tree[2])
        if a < 0 and n is not None and n.denominator == 1 and n.numerator % 2:
            return -((-a) ** (1 / b))
        kind, b = "^", 1 / b
    if kind == "^":
        found = a**b
        if isinstance(found, complex):
            raise ValueError("not a real number")
        return found
    return a + b if kind == "+" else a * b if kind == "*" else a / b


def same_rational(a: tuple, b: tuple, unknowns: list[str], rng: random.Random) -> bool:
    for p in PRIMES:
        root = next(pow(g, (p - 1) // 4, p) for g in range(2, 1000) if pow(g, (p - 1) // 2, p) == p - 1)
        agreed = 0
        for _ in range(POINTS * 4):
            at = {x: root if x == "i" else rng.randrange(1, p) for x in unknowns}
            try:
                if modulo(a, at, p) != modulo(b, at, p):
                    return False
            except ZeroDivisionError:  # a pole; another point
                continue
            agreed += 1
            if agreed == POINTS:
                break
        if agreed < POINTS:
            return False
    return True


def same_real(a: tuple, b: tuple, unknowns: list[str], rng: random.Random) -> bool:
    if "i" in unknowns:
        raise ValueError("complex values aren't compared in floating point")
    agreed = 0
    for k in range(TRIES):
        low, high = ((0.2, 3.0), (-3.0, 3.0), (0.05, 0.95))[k % 3]
        at = {x: CONSTANTS.get(x) or rng.uniform(low, high) for x in unknowns}
        try:
            x, y = real(a, at), real(b, at)
        except (ValueError, ArithmeticError):
            continue
        if not (math.isfinite(x) and math.isfinite(y)):
            continue
        if abs(x - y) > NEAR * max(1.0, abs(x), abs(y)):
            return False
        agreed += 1
    return agreed >= LEAST_POINTS


def same_tree(a: tuple, b: tuple, seed: str) -> bool:
    unknowns, rng = sorted(names(a) | names(b)), random.Random(seed)
    rational = degree(a) is not None and degree(b) is not None
    return (same_rational if rational else same_real)(a, b, unknowns, rng)


_SOLVED = re.compile(r"^\s*(?:[a-zA-Z](?:_\{?\w+\}?)?|[a-zA-Z]\([a-zA-Z]\))\s*=(?!=)")


def _sides(text: str) -> list[str]:
    return re.split(r"(?<![<>=!\\])=(?!=)", text)


def identical(given: str, truth: str) -> bool:
    """Whether two texts are the same expression or equation; an equation that only names an expression counts as that.

    Two texts of letters alone are names, not products.
    """
    if given.isalpha() and truth.isalpha():
        return given == truth
    try:
        seed, (g, t) = f"{given}\0{truth}", (_sides(given), _sides(truth))
        if len(g) == len(t) == 2:
            a, b = (("+", parse(x[0]), _negative(parse(x[1]))) for x in (g, t))
            return _proportional(a, b, seed)
        g, t = (x[-1:] if len(x) == 2 and _SOLVED.match(text) else x for x, text in ((g, given), (t, truth)))
        return len(g) == len(t) == 1 and same_tree(parse(g[0]), parse(t[0]), seed)
    except (ValueError, ArithmeticError, IndexError, RecursionError):
        return False


def _proportional(a: tuple, b: tuple, seed: str) -> bool:
    """Whether two sides' differences are the same but for a factor that isn't an expression with unknowns."""
    if same_tree(a, b, seed) or same_tree(a, _negative(b), seed):
        return True
    if degree(a) is None or degree(b) is None:
        return False
    rng, unknowns, zero = random.Random(seed), sorted(names(a) | names(b)), ("n", Fraction(0))
    if same_tree(a, zero, seed) or same_tree(b, zero, seed):
        return False
    # a(first) b(x) = b(first) a(x) at another point, modulo each prime
    for p in PRIMES:
        first, second = ({x: rng.randrange(1, p) for x in unknowns} for _ in range(2))
        if modulo(a, first, p) * modulo(b, second, p) % p != modulo(b, first, p) * modulo(a, second, p) % p:
            return False
    return True
