"""One compile step for the fixed patterns: what must hold for all of them is set here, not in the values."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import lru_cache, reduce
from re import _constants as parts
from re import _parser as parser
from types import ModuleType, SimpleNamespace
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from gavel.functions.exprs import bind

#: Blanks other than U+0020 and the control characters: no-break, typographic and wide ones.
OTHER_BLANKS = "\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000"


def plain_blanks(text: Column) -> Column:
    """Text whose blanks are all U+0020, so that ``\\s`` and literal blanks of a pattern see them."""
    plain = F.translate(text, OTHER_BLANKS, " " * len(OTHER_BLANKS))  # slow: character by character
    # a text of as many bytes as characters has none of them
    return F.when((F.octet_length(text) > F.char_length(text)) & text.rlike("[\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000]"), plain).otherwise(text)


def case_blind(value: Any) -> Any:
    """Patterns (also in lists, tuples and dicts) that ignore case in every script where they ignore it in Latin."""
    if isinstance(value, str):
        return value.replace("(?i)", "(?iu)").replace("(?im)", "(?imu)")
    if isinstance(value, (list, tuple)):
        return type(value)(case_blind(v) for v in value)
    if isinstance(value, dict):
        return {k: case_blind(v) for k, v in value.items()}
    return value


def compiled(rules: ModuleType) -> SimpleNamespace:
    """The upper-case values of a module, ready for use."""
    return SimpleNamespace(**{k: case_blind(v) for k, v in vars(rules).items() if k.isupper()})


# ---- patterns that are tried only where something like them occurs, told for a batch of texts at once ----

#: Letters whose cases may leave their script: texts with them are tried with every pattern.
_ODD_LETTERS = r"[^\x00-\x7F\x{400}-\x{45F}\x{600}-\x{6FF}\pS\pP\pZ\pM\pN]"
#: Texts that patterns of Java and of Python read alike: ASCII without separators, Cyrillic, common punctuation and emoji.
PLAIN_TEXT = r"^[\t\n\x20-\x7E\x{401}\x{410}-\x{44F}\x{451}\x{2013}\x{2014}\x{2018}\x{2019}\x{201C}\x{201D}\x{2022}\x{20AC}\x{2600}-\x{26FF}\x{1F300}-\x{1FAFF}]*$"
_WIDE_CLASS = {parts.CATEGORY_DIGIT: r"\p{Nd}", parts.CATEGORY_SPACE: r"\s\x0B\x1C-\x1F\x{85}\pZ", parts.CATEGORY_WORD: r"\w\pL\pN\pM\p{Pc}"}
_NARROW_CLASS = {parts.CATEGORY_DIGIT: "0-9", parts.CATEGORY_SPACE: r"\s\x0B", parts.CATEGORY_WORD: r"\w"}
_ANYTHING = "(?s:.)"


def _class(items: Sequence) -> str:
    """A class with at least the characters of the parsed one."""
    negated = items[0][0] is parts.NEGATE
    out = ""
    for op, arg in items[negated:]:
        if op is parts.LITERAL:
            arg = (arg, arg)
        if op in (parts.LITERAL, parts.RANGE):
            if negated and any(chr(c).isalpha() for c in range(arg[0], arg[1] + 1)):
                return _ANYTHING
            out += f"\\x{{{arg[0]:x}}}-\\x{{{arg[1]:x}}}"
        else:
            known = (_NARROW_CLASS if negated else _WIDE_CLASS).get(arg)
            if known is None:
                return _ANYTHING
            out += known
    return f"[{'^' if negated else ''}{out}]"


def _loose(items: Sequence) -> str:
    out = ""
    for op, arg in items:
        if op is parts.LITERAL:
            out += f"\\x{{{arg:x}}}"
        elif op is parts.NOT_LITERAL:
            out += _class([(parts.NEGATE, None), (parts.LITERAL, arg)])
        elif op is parts.ANY:
            out += _ANYTHING
        elif op is parts.IN:
            out += _class(arg)
        elif op is parts.SUBPATTERN:
            out += f"(?:{_loose(arg[3])})"
        elif op is parts.BRANCH:
            out += f"(?:{'|'.join(map(_loose, arg[1]))})"
        elif op in (parts.MAX_REPEAT, parts.MIN_REPEAT):
            least, most, inner = arg
            out += f"(?:{_loose(inner)}){{{least},{'' if most is parts.MAXREPEAT else most}}}"
        elif op not in (parts.AT, parts.ASSERT, parts.ASSERT_NOT):  # those have no width
            raise ValueError(op)
    return out


def _edge(items: list, at: int) -> list:
    """Without what may be missing at an end (0 or -1), as a search does not need it."""
    while items:
        op, arg = items[at]
        if op is parts.ASSERT and arg[0] == (1 if at else -1):  # what must stand behind the end, or before the beginning
            inner = list(arg[1])
        elif op in (parts.AT, parts.ASSERT, parts.ASSERT_NOT) or (op in (parts.MAX_REPEAT, parts.MIN_REPEAT) and arg[0] == 0):
            inner = []
        elif op is parts.SUBPATTERN:
            inner = list(arg[3])
        elif op in (parts.MAX_REPEAT, parts.MIN_REPEAT) and arg[:2] != (1, 1):
            inner = [(op, (arg[0], arg[0], arg[2]))] if arg[0] > 1 else list(arg[2])
            if arg[0] > 1 and arg[1] == arg[0]:
                return items
        else:
            return items
        items = inner + items[1:] if at == 0 else items[:-1] + inner
    return items


@lru_cache(maxsize=None)
def loose(pattern: str) -> str | None:
    """A pattern for Arrow that is found in every text, but those with ``_ODD_LETTERS``, in which the given one is found; boundaries
    and most of what stands before or behind are left out. None where that cannot be told."""
    flags, body = re.fullmatch(r"((?:\(\?[a-zA-Z]+\))*)(.*)", pattern, re.S).groups()
    if "x" in flags or re.search(r"\\[QEGhHvVRXpPkNxc]|&&|\(\?[a-zA-Z]|\[[^\]]*\[|[*+?}]\+", body):
        return None
    try:
        out = _loose(_edge(_edge(list(parser.parse(body)), 0), -1))
        pc.match_substring_regex(pa.array([""]), "(?i)" + out)
    except (re.error, ValueError, pa.ArrowInvalid):
        return None
    return "(?i)" + out if out else None


def _valid(texts: pa.Array) -> bool:
    try:
        texts.validate(full=True)
    except pa.ArrowInvalid:
        return False
    return True


def _found(texts: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(texts, pattern).fill_null(False).to_numpy(zero_copy_only=False)


#: Patterns of one number.
_BITS = 62


def look(text: Column, patterns: Sequence[str]) -> Column:
    """struct(text, s0, s1…): a text and, as bits, which of the patterns may be found in it. See :class:`Seen`."""
    gates = [loose(p) for p in patterns]
    names = [f"s{i}" for i in range(-(-len(gates) // _BITS))]

    @F.arrow_udf("struct<" + ", ".join(["text:string", *[f"{n}:bigint" for n in names]]) + ">")
    def looked(texts: pa.Array) -> pa.Array:
        readable = _valid(texts)
        every = _found(texts, _ODD_LETTERS) if readable else np.ones(len(texts), dtype=bool)
        none = texts.is_null().to_numpy(zero_copy_only=False)
        columns = []
        for i in range(len(names)):
            bits = np.where(every, np.int64(-1), np.int64(0))
            for k, gate in enumerate(gates[i * _BITS : (i + 1) * _BITS]):
                bits |= (np.int64(1) if gate is None or not readable else _found(texts, gate).astype(np.int64)) << np.int64(k)
            columns.append(pa.array(bits, mask=none))
        return pa.StructArray.from_arrays([texts, *columns], ["text", *names])

    return looked(text)


@dataclass(frozen=True)
class Seen:
    """What :func:`look` gave for ``order``, bound. :func:`says` and :func:`pull` read it."""

    bound: Column
    order: Mapping[str, int]

    @property
    def text(self) -> Column:
        return self.bound["text"]

    def may(self, pattern: str) -> Column:
        at = self.order[pattern]
        return self.bound[f"s{at // _BITS}"].bitwiseAND(F.lit(1 << at % _BITS)) != 0


class _Asked(dict):
    """Numbers patterns as they are asked for."""

    def __missing__(self, pattern: str) -> int:
        return self.setdefault(pattern, len(self))


def said(read: Callable[..., Column], *texts: Column, **beside: Column) -> Column:
    """``read`` over the texts as :class:`Seen` and over further columns, all bound once."""
    asked = [_Asked() for _ in texts]
    read(*[Seen(F.lit(None), a) for a in asked], **beside)  # tells which patterns are looked for
    looks = F.struct(*[look(t, list(a)).alias(f"t{i}") for i, (t, a) in enumerate(zip(texts, asked))], *[c.alias(k) for k, c in beside.items()])
    return bind(looks, lambda x: read(*[Seen(x[f"t{i}"], dict(a)) for i, a in enumerate(asked)], **{k: x[k] for k in beside}))


def rewritten(text: Column, steps: Sequence[tuple]) -> Column:
    """The text after replacements, one after the other; NULL where it is not ``PLAIN_TEXT``, which is left to Spark's own functions.

    A step is (pattern, replacement) or (pattern, replacement, pattern that must be found); a replacement is a text with ``$1``… or a mapping of characters.
    """
    if any(re.search(r"\[[^\]]*\\[wWbB]|\\[WDS]", p) for p, *_ in steps):
        raise ValueError("classes of Java and Python differ")

    def split(pattern: str) -> tuple[str, str]:
        return re.fullmatch(r"((?:\(\?[a-zA-Z]+\))*)(.*)", pattern, re.S).groups()

    def own(pattern: str) -> re.Pattern:
        flags, body = split(pattern)
        return re.compile(body.replace(r"\w", "[A-Za-z0-9_]"), reduce(lambda f, c: f | {"i": re.I, "s": re.S, "m": re.M}.get(c, 0), flags, re.NOFLAG))

    def ready(pattern: str, into: str | Mapping[str, str], only: str | None = None) -> tuple:
        if not isinstance(into, str):
            return loose(pattern), lambda t: reduce(lambda t, c: t.replace(*c), into.items(), t), None, None, None, None
        flags, body = split(pattern)
        find, put = own(pattern), re.sub(r"\$(\d)", r"\\g<\1>", into)
        # Arrow replaces what has no look-around; it knows word boundaries of Latin letters only
        fast = None if only or re.search(r"\(\?<?[=!]", body) or find.search("") else "".join(f"(?{f})" for f in "ism" if f in flags) + body
        return loose(pattern), lambda t: find.sub(put, t), only and loose(only), only and own(only), fast, re.sub(r"\$(\d)", r"\\\1", into)

    plan = [ready(*step) for step in steps]

    @F.arrow_udf("string")
    def rewrite(texts: pa.Array) -> pa.Array:
        if not _valid(texts):
            return pa.nulls(len(texts), pa.string())
        now = pc.if_else(pc.match_substring_regex(texts, PLAIN_TEXT), texts, pa.scalar(None, texts.type))
        latin = ~_found(now, r"[\x{400}-\x{4FF}]")
        for gate, run, only_gate, only, fast, put in plan:
            rows = _found(now, gate) if gate else now.is_valid().to_numpy(zero_copy_only=False)
            if only_gate:
                rows = rows & _found(now, only_gate)
            if fast and (quick := rows & latin).any():
                mask = pa.array(quick)
                now = pc.replace_with_mask(now, mask, pc.replace_substring_regex(now.filter(mask), fast, put))
                rows = rows & ~latin
            if rows.any():
                mask = pa.array(rows)
                now = pc.replace_with_mask(now, mask, pa.array([run(t) if only is None or only.search(t) else t for t in now.filter(mask).to_pylist()], now.type))
        return now

    return rewrite(text)


# ---- patterns that are tried only where a word of theirs occurs ------------------------


def folded(text: Column) -> Column:
    """Text in which letters that a case-blind pattern takes for the same are the same."""
    return F.lower(F.upper(F.when(F.contains(text, F.lit("\u0130")), F.translate(text, "\u0130", "i")).otherwise(text)))


def _plain(code: int) -> bool:
    """Characters that are folded one by one: ASCII, Cyrillic and Arabic."""
    return 0x20 <= code < 0x7F or 0x400 <= code <= 0x45F or 0x600 <= code <= 0x6FF


def _needed(items: Sequence) -> frozenset[str] | None:
    """Of the parsed sequence: strings of which every match holds one, the longest there are."""
    found: list[frozenset[str]] = []
    run = ""
    for op, arg in items:
        if op is parts.AT or op in (parts.ASSERT, parts.ASSERT_NOT):  # no width: the run goes on
            continue
        if op is parts.LITERAL and _plain(arg):
            run += chr(arg).upper().lower()
            continue
        found, run = found + [frozenset([run])] * bool(run), ""
        inner: frozenset[str] | None = None
        if op is parts.SUBPATTERN:
            inner = _needed(arg[3])
        elif op is parts.BRANCH:
            sets = [_needed(b) for b in arg[1]]
            inner = None if None in sets else frozenset().union(*sets)
        elif op in (parts.MAX_REPEAT, parts.MIN_REPEAT) and arg[0] >= 1:
            inner = _needed(arg[2])
        if inner:
            found.append(inner)
    found += [frozenset([run])] * bool(run)
    return max(found, key=lambda words: (min(map(len, words)), -len(words)), default=None)


@lru_cache(maxsize=None)
def needed_words(pattern: str) -> tuple[str, ...]:
    """Folded strings of which every match of the pattern holds at least one; none if that cannot be told or would be too
    many or too short to save work. Syntax that Python does not share with Java is left alone."""
    flags, body = re.fullmatch(r"((?:\(\?[a-zA-Z]+\))*)(.*)", pattern, re.S).groups()
    if "x" in flags or re.search(r"\\[QEGZAhHvVRXpPkNxc]|&&|\(\?[a-zA-Z]|\[[^\]]*\[|[*+?}]\+", body):
        return ()
    try:
        words = _needed(parser.parse(body))
    except re.error:
        return ()
    return tuple(sorted(words)) if words and min(map(len, words)) >= 2 and len(words) <= 24 else ()


def with_fold(text: Column) -> Column:
    """What :func:`says` and :func:`pull` read: a text and its folded form, to be bound once."""
    return F.struct(text.alias("text"), folded(text).alias("fold"))


def says(x: Column | Seen, pattern: str) -> Column:
    """``rlike``; the pattern runs only on texts that hold one of its words, or where a batch was looked through for it."""
    if isinstance(x, Seen):
        return x.may(pattern) & x.text.rlike(pattern)
    hit, words = x["text"].rlike(pattern), needed_words(pattern)
    return reduce(lambda a, b: a | b, [x["fold"].contains(w) for w in words]) & hit if words else hit


def pull(x: Column | Seen, pattern: str, group: int) -> Column:
    """``regexp_extract``, likewise; NULL, which is cheaper to cast than an empty text, where no word occurs."""
    if isinstance(x, Seen):
        return F.when(x.may(pattern), F.regexp_extract(x.text, pattern, group))
    got, words = F.regexp_extract(x["text"], pattern, group), needed_words(pattern)
    return F.when(reduce(lambda a, b: a | b, [x["fold"].contains(w) for w in words]), got) if words else got


def blanked(texts: Column, patterns: Sequence[str]) -> Column:
    """Array of texts in which the matches of the patterns, one after the other, became a blank. A pattern runs only on texts that
    hold one of its words: a blank in place of a match makes no word, so the words of the text as given decide."""

    def step(pattern: str):
        def run(x: Column) -> Column:
            words = needed_words(pattern)
            done = F.regexp_replace(x["text"], pattern, " ")
            if words and not any(" " in w for w in words):
                done = F.when(reduce(lambda a, b: a | b, [x["fold"].contains(w) for w in words]), done).otherwise(x["text"])
            return F.struct(done.alias("text"), x["fold"].alias("fold"))

        return run

    return F.transform(reduce(lambda a, p: F.transform(a, step(p)), patterns, F.transform(texts, with_fold)), lambda x: x["text"])
