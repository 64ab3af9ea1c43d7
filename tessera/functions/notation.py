"""Printed move text: tokens, numbered runs, and a generator of noisy text for benchmarks."""

from __future__ import annotations

import random
import re
from dataclasses import asdict, dataclass, field

from . import notation_values as V

#: Characters after which an open bracket counts as closed; the second for a square one before a space.
EXPIRY, EXPIRY_SPACED = 600, 3000
_DIGIT = "0-9lI|OoSsB"
_RESULT = re.compile(r"(?:1-0|0-1|1/2-1/2|½-½|\*)(?=[ \n\r\xa0.,;)]|$)")
_NUMBER = re.compile(rf"((?:[1-9lISsB][{_DIGIT}]{{0,2}}|[1-9lI] [{_DIGIT}](?= ?\.))) ?(\.(?: ?\. ?\.)?|…)", re.S)
_CASTLE = r"[O0o]-[O0o](?:-[O0o])?"
_CLEAR = re.compile(rf"(?:{_CASTLE}|[KQRBNDTLSFCA♔-♟]?[a-h]?[1-8]?[x:×]?[a-h][1-8](?:=?[QRBN♕-♘])?)[+#†‡!?]*$")
#: A number without a dot, and pairs of numbers that follow each other around plainly printed moves, without dots and with them.
_BARE = re.compile(r"([1-9][0-9]{0,2})(?=[ \n])")
_PLAIN = r"(?:(?:[KQRBN]?[a-h1-8]?x?[a-h][1-8](?:=[QRBN])?|[O0]-[O0](?:-[O0])?)[+#!?]*)"
DOTLESS_PAIR, DOTTED_PAIR = (rf"(?<![\w.,])([0-9]{{1,3}}){dot}{_PLAIN}(?: {_PLAIN})? ([0-9]{{1,3}}){dot}{_PLAIN}(?!\w)" for dot in (" ", r"\. ?"))
#: Real spaces only: control characters are data.
_WORD = re.compile("[^ \n\r\xa0]+")
_SQUARE_END = re.compile(r"[a-h£otqr9€ƒkC]['`’]?[1-8lIi!|\]jBSsbGZzTA?]?[t+#!?=.,;]*$")
_STOP = frozenset("a an and as at be but by for he her his if in is it its no not of on or she so that the then they this to was we with you".split())


@dataclass
class Token:
    """kind: number, move, result or other; places are offsets in the text."""

    kind: str
    raw: str
    start: int
    end: int
    number: int | None = None
    black: bool | None = None


@dataclass
class Run:
    """Moves under consecutive numbers."""

    first_number: int | None
    black_first: bool
    depth: int
    start: int
    end: int
    tokens: list[Token] = field(default_factory=list)


def number_values(raw: str) -> list[int]:
    """All values of a printed number: S reads as 8 and as 5; no leading zero, three characters at most."""
    plain = raw.replace(" ", "")
    out = []
    for eight in "85":
        digits = plain.translate(str.maketrans("lI|OoSsB", f"11100{eight}{eight}8"))
        if len(plain) <= 3 and digits.isdigit() and digits[0] != "0" and int(digits) not in out:
            out.append(int(digits))
    return out


def misreadings(number: int) -> set[int]:
    """The numbers that a number is taken for when one of its digits is misread."""
    out = set()
    for place in (10**k for k in range(len(str(number)))):
        digit = number // place % 10
        for pair in V.DIGIT_SLIPS:
            if digit in pair:
                out.add(number + (sum(pair) - 2 * digit) * place)
    return out


def slipped(printed: str, want: int) -> bool:
    """Whether a printed number is another one with a single digit misread as one that it is taken for."""
    shown = "".join(c for c in printed if "0" <= c <= "9")
    return len(shown) == len(str(want)) and int(shown) in misreadings(want)


def _looks(word: str, exact: bool) -> str:
    """strong, weak or an empty string: how much a word looks like a move."""
    bare = word.rstrip(".,;:")
    if _CLEAR.match(bare):
        return "strong"
    if exact or bare.lower() in _STOP or len(bare) > 12:
        return ""
    if _SQUARE_END.search(word) and (any(c.isdigit() or ord(c) < 32 or not c.isalnum() for c in bare) or (len(bare) <= 3 and bare[:1] in "abcdefgh")):
        return "weak"
    return ""


def tokenize(text: str, exact: bool = False, dotless: bool = False) -> list[Token]:
    """All words as tokens; dotless: a number needs no dot before a word that clearly is a move. A number opens a run; within one, words that look like moves are moves, and a short unreadable word right after a number is one too."""
    out: list[Token] = []
    at, expected, since = 0, None, 99
    for word in _WORD.finditer(text):
        at = max(at, word.start())
        while at < word.end():
            rest = text[at : word.end()]
            if m := _RESULT.match(text, at):
                out.append(Token("result", m[0], at, m.end()))
                at, expected = m.end(), None
                continue
            m = _NUMBER.match(text, at)
            values = number_values(m[1]) if m else []
            if m and values and (m[1][0].isdigit() or expected in values or (not exact and m.end() < len(text) and _looks(_WORD.match(text, m.end()).group() if _WORD.match(text, m.end()) else "", exact))):
                value = expected if expected in values else values[0]
                black = len(m[2].replace(" ", "")) > 1 or m[2] == "…"
                out.append(Token("number", m[0], at, m.end(), value, black))
                at, expected, since = m.end(), value if black is False else value + 1, 0
                if not black:
                    expected = value + 1
                continue
            bare = _BARE.match(text, at) if dotless else None
            if bare and (following := _WORD.match(text, bare.end() + 1)) and _looks(following[0], True) and (expected is None or int(bare[1]) in (expected, expected - 1) or since > 1):
                value, black = int(bare[1]), expected is not None and int(bare[1]) == expected - 1 and since == 1
                out.append(Token("number", bare[0], at, bare.end(), value, black))
                at, expected, since = bare.end(), value + 1, 0
                continue
            glued = None if exact or expected is None else next((g for n in (3, 2, 1) for g in re.finditer(rf"(?<=[1-8lIsSBbGi!t#+])(?=([{_DIGIT}]{{{n}}})\.)", rest) if expected in number_values(g[1])), None)
            if glued:
                rest = rest[: glued.start()]
            if rest[0] in "([{":
                out.append(Token("other", rest[0], at, at + 1))
                at += 1
                continue
            core = rest.rstrip(")]}")
            shape = _looks(core, exact) if core else ""
            in_run = expected is not None and since < 4
            if core and not shape and not exact and in_run and since == 1 and _SQUARE_END.search(core) and core.lower() not in _STOP and not (len(core) > 4 and core.isalpha() and core.islower()):
                after = _WORD.search(text, at + len(core))  # one move is missing before the number that must follow
                following = _NUMBER.match(text, after.start()) if after else None
                shape = "weak" if following and expected in number_values(following[1]) else ""
            if core and (shape == "strong" or (shape and in_run) or (not exact and in_run and since == 0 and len(core) <= 6 and core.lower() not in _STOP)) and (in_run or shape == "strong"):
                out.append(Token("move", core.rstrip(",;") if shape else core, at, at + len(core)))
                since += 1
                at += len(core)
            elif core:
                out.append(Token("other", core, at, at + len(core)))
                expected, at = (None if len(core) > 1 else expected), at + len(core)
            for c in rest[len(core) :]:
                out.append(Token("other", c, at, at + 1))
                at += 1
    return out


def _confirmed(tokens: list[Token], k: int, number: int, most: int = 4) -> bool:
    """Whether the next number after token k, a few moves on, is the one after `number`, or the run ends without another."""
    for t in tokens[k + 1 : k + 2 + most]:
        if t.kind == "number":
            return t.number in (number, number + 1)
        if t.kind != "move":
            break
    return True


def runs(tokens: list[Token], ahead: int = 1) -> list[Run]:
    """Runs of moves: a number that fits or is one ahead goes on, so does one that a misread digit makes another if the numbers after it agree (it is
    numbered anew); anything else closes; brackets give the depth."""
    out: list[Run] = []
    run: Run | None = None
    ply, open_at = 0, []  # limits of the open brackets
    for k, t in enumerate(tokens):
        while open_at and t.start > open_at[-1]:  # a bracket that was never closed
            open_at.pop()
            run = None
        depth = len(open_at)
        if t.kind == "other":
            if t.raw in "([{":
                spaced = t.raw == "[" and k + 1 < len(tokens) and tokens[k + 1].start > t.end
                open_at.append(t.start + (EXPIRY_SPACED if spaced else EXPIRY))
                run = None
            elif t.raw in ")]}":
                del open_at[-1:]
                run = None
            else:
                run = None
        elif t.kind == "result":
            run = None
        elif t.kind == "number":
            printed = 2 * (t.number - 1) + bool(t.black)
            if run is not None and not ply <= printed <= ply + ahead and slipped(t.raw, ply // 2 + 1) and _confirmed(tokens, k, ply // 2 + 1):
                t.number = ply // 2 + 1
                printed = 2 * (t.number - 1) + bool(t.black)
            if run is None or not ply <= printed <= ply + ahead and not (t.black and printed == ply):
                run = Run(t.number, bool(t.black), depth, t.start, t.end)
                out.append(run)
            ply = printed
        elif run is not None:
            t.number, t.black = ply // 2 + 1, ply % 2 == 1
            run.tokens.append(t)
            run.end, ply = t.end, ply + 1
    return [r for r in out if r.tokens]


def bare_runs(tokens: list[Token]) -> list[Run]:
    """Moves that stand next to each other under no number, from the first one's side unknown."""
    inside, out = {id(t) for r in runs(tokens) for t in r.tokens}, []
    for k, t in enumerate(tokens):
        if t.kind != "move" or id(t) in inside:
            continue
        if out and k and tokens[k - 1] is out[-1].tokens[-1]:
            out[-1].tokens.append(t)
            out[-1].end = t.end
        else:
            out.append(Run(None, False, 0, t.start, t.end, [t]))
    return out


def clean(run_costs: list[float | None], most_failed: float = 0.2, mean: float = 1.5) -> bool:
    """A run reads cleanly: few failures, none at the start, and cheap on the whole."""
    failed = [c is None for c in run_costs]
    read = [c for c in run_costs if c is not None]
    return bool(read) and not failed[0] and sum(failed) <= most_failed * len(failed) and sum(read) / len(read) <= mean


def rows(items: list) -> list[dict]:
    return [asdict(x) for x in items]


@dataclass(frozen=True)
class Edit:
    """A misprint: the rate at which it happens, the words it happens in (move or number), whether only junk fonts have it, what it replaces and what may stand there."""

    rate: str
    words: str
    junk: bool
    pattern: re.Pattern
    options: tuple[str, ...]
    #: How often each option is taken; equally often if not said.
    shares: tuple[float, ...] | None = None

    def made(self, word: str, rates: dict[str, float], rng: random.Random) -> str:
        return self.pattern.sub(lambda m: m.expand(rng.choices(self.options, self.shares)[0]) if rng.random() < rates[self.rate] else m[0], word)


def _edits() -> list[Edit]:
    """All misprints in the order in which they are made: number, capture mark, sign, square from its rank to its file, piece. Each is independent of the others."""
    end, out = r"(?=(?:=[QRBN])?[+#t]?$)", []

    def edit(rate: str, pattern: str, *options: str, words: str = "move", junk: bool = False, shares: tuple[float, ...] | None = None) -> None:
        out.append(Edit(rate, words, junk, re.compile(pattern), options, shares))

    edit("ocrnum", "1", "l", "I", words="number")
    edit("ocrnum", "0", "O", "o", words="number")
    edit("split", r"^(\w)(\w)\.$", r"\1 \2.", words="number")
    edit("xvar", "x", "x:", ":x", junk=True)
    edit("xdrop", ":?x:?", "")
    edit("chkdrop", "[+#]$", "")
    edit("always", r"\+$", "t", junk=True)
    edit("l1", f"1{end}", "l", junk=True)
    edit("s8", f"8{end}", "s", junk=True)
    for rank, others in V.RANK_CONFUSIONS.items():
        edit("sq", rank + end, *others)
    edit("f_pound", r"f(?=\S(?:=[QRBN])?[+#t]?$)", *V.DAMAGED_F, shares=(V.DAMAGED_F_SHARE, 1 - V.DAMAGED_F_SHARE))
    for file, others in V.FILE_CONFUSIONS.items():
        edit("sq", rf"{file}(?=\S(?:=[QRBN])?[+#t]?$)", *others)
    edit("drop", "^[KQRBN]", "")
    for piece, signs in V.JUNK.items():
        edit("always", f"^{piece}|(?<==){piece}", *[x.replace("\\", r"\\") for x in signs], junk=True)
    edit("always", "O", "0", junk=True)
    return out


EDITS = _edits()


def misprinted(word: str, words: str, rates: dict[str, float], rng: random.Random, junk: bool) -> str:
    for e in EDITS:
        if e.words == words and (junk or not e.junk):
            word = e.made(word, rates, rng)
    return word


def printed(sans: list[str], level: str, rng: random.Random, junk: bool) -> str:
    """A game as a badly printed book has it: each word is misprinted by itself at a level's rates, then words are set in lines."""
    rates, lines = V.LEVELS[level] | {"always": 1.0}, ""
    for k, san in enumerate(sans):
        move, number = misprinted(san, "move", rates, rng, junk), str(k // 2 + 1)
        if k % 2 == 0:
            number = misprinted(f"{number}.", "number", rates, rng, junk)
        else:
            number = f"{number}..." if rng.random() < rates["black_repeat"] else ""
        stuck = k % 2 == 0 and lines[-1:].isdigit() and " " not in number and rng.random() < rates["glue"]
        gap = "" if stuck or not lines else "\n" if rng.random() < V.LINE_BREAK else " "
        lines += gap + number + move
    return lines
