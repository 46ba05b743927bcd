"""String functions: on every string of an array, at any depth.

Characters are Unicode code points. A missing string gives a missing result. Patterns of the _regex functions are Java's
regular expressions; all others are taken as they stand. Padding takes one character and never cuts. center puts the
odd character to the right. title capitalises after everything that isn't a letter. split_whitespace splits at stretches
of white space and keeps the empty strings at a text's ends. join gives a missing string if one of the list's is.
"""

from __future__ import annotations

import builtins
import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragtide.operators.array import Array, Scalar, aligned, elementwise
from ragtide.operators.node import Leaf, fresh, let, lift

_STRING, _BOOL, _LONG = T.StringType(), T.BooleanType(), T.LongType()


def _each(array: Array, fn, dtype: T.DataType | None, name: str, *more: Any) -> Array:
    if not isinstance(array, Array):
        raise TypeError(f"str.{name}: a lazy array is needed")
    return elementwise(fn, array, *more, name=f"str.{name}", dtype=dtype)


def _quoted(pattern: str) -> str:
    return "\\Q" + pattern.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def _regex(pattern: str, ignore_case: bool = False) -> str:
    """Named groups as Java writes them; (?iu): case of all letters."""
    pattern = pattern.replace("(?P<", "(?<")
    return f"(?iu){pattern}" if ignore_case else pattern


def _plain(pattern: str, ignore_case: bool) -> str:
    return _regex(_quoted(pattern), ignore_case)


# Case.
def capitalize(array: Array) -> Array:
    return _each(array, lambda s: F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substr(s, F.lit(2)))), _STRING, "capitalize")


def lower(array: Array) -> Array:
    return _each(array, F.lower, _STRING, "lower")


def upper(array: Array) -> Array:
    return _each(array, F.upper, _STRING, "upper")


def swapcase(array: Array) -> Array:
    swap = lambda c: F.when(c == F.lower(c), F.upper(c)).otherwise(F.lower(c))
    return _each(array, lambda s: F.array_join(F.transform(F.split(s, ""), swap), ""), _STRING, "swapcase")


def _titled(s: Column) -> Column:
    words = F.regexp_extract_all(s, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))), "")


def title(array: Array) -> Array:
    return _each(array, _titled, _STRING, "title")


# Tests.
def _matches(name: str, pattern: str):
    def fn(array: Array) -> Array:
        return _each(array, lambda s: F.rlike(s, F.lit(pattern)), _BOOL, name)

    fn.__name__ = name
    return fn


is_alnum = _matches("is_alnum", r"\A[\p{L}\p{N}]+\z")
is_alpha = _matches("is_alpha", r"\A\p{L}+\z")
is_ascii = _matches("is_ascii", r"\A\p{ASCII}*\z")
is_decimal = _matches("is_decimal", r"\A\p{Nd}+\z")
#: Besides decimals these digits, in superscript and the like.
is_digit = _matches("is_digit", r"\A[\p{Nd}\u00B2\u00B3\u00B9\u2070\u2074-\u2079\u2080-\u2089]+\z")
is_numeric = _matches("is_numeric", r"\A\p{N}+\z")
is_printable = _matches("is_printable", r"\A(?:[^\p{C}\p{Z}]|\x20)*\z")
is_space = _matches("is_space", r"(?U)\A\s+\z")


def is_lower(array: Array) -> Array:
    return _each(array, lambda s: (s == F.lower(s)) & (F.upper(s) != s), _BOOL, "is_lower")


def is_upper(array: Array) -> Array:
    return _each(array, lambda s: (s == F.upper(s)) & (F.lower(s) != s), _BOOL, "is_upper")


def is_title(array: Array) -> Array:
    return _each(array, lambda s: (s == _titled(s)) & F.rlike(s, F.lit(r"\p{L}")), _BOOL, "is_title")


# Search.
def starts_with(array: Array, pattern: str, ignore_case: bool = False) -> Array:
    return _each(array, lambda s: F.rlike(s, F.lit(r"\A" + _plain(pattern, True))) if ignore_case else F.startswith(s, F.lit(pattern)), _BOOL, "starts_with")


def ends_with(array: Array, pattern: str, ignore_case: bool = False) -> Array:
    return _each(array, lambda s: F.rlike(s, F.lit(_plain(pattern, True) + r"\z")) if ignore_case else F.endswith(s, F.lit(pattern)), _BOOL, "ends_with")


def match_substring(array: Array, pattern: str, ignore_case: bool = False) -> Array:
    return _each(array, lambda s: F.rlike(s, F.lit(_plain(pattern, True))) if ignore_case else F.contains(s, F.lit(pattern)), _BOOL, "match_substring")


def match_substring_regex(array: Array, pattern: str, ignore_case: bool = False) -> Array:
    return _each(array, lambda s: F.rlike(s, F.lit(_regex(pattern, ignore_case))), _BOOL, "match_substring_regex")


def match_like(array: Array, pattern: str, ignore_case: bool = False) -> Array:
    """SQL's LIKE: % for any characters, _ for one, a backslash before a sign that stands for itself."""
    return _each(array, lambda s: F.ilike(s, F.lit(pattern)) if ignore_case else F.like(s, F.lit(pattern)), _BOOL, "match_like")


def count_substring(array: Array, pattern: str, ignore_case: bool = False) -> Array:
    return count_substring_regex(array, _quoted(pattern), ignore_case)


def count_substring_regex(array: Array, pattern: str, ignore_case: bool = False) -> Array:
    return _each(array, lambda s: F.regexp_count(s, F.lit(_regex(pattern, ignore_case))).cast("bigint"), _LONG, "count_substring_regex")


def find_substring(array: Array, pattern: str, ignore_case: bool = False) -> Array:
    """The first place, or -1."""
    if ignore_case:
        return find_substring_regex(array, _quoted(pattern), True)
    return _each(array, lambda s: (F.instr(s, pattern) - 1).cast("bigint"), _LONG, "find_substring")


def find_substring_regex(array: Array, pattern: str, ignore_case: bool = False) -> Array:
    """The first match's place, or -1: the length of what stands before it."""
    whole = _regex(pattern, ignore_case)
    return _each(array, lambda s: F.when(F.rlike(s, F.lit(whole)), F.char_length(F.get(F.split(s, whole, 2), F.lit(0)))).when(s.isNotNull(), F.lit(-1)).cast("bigint"), _LONG, "find_substring_regex")


def extract_regex(array: Array, pattern: str) -> Array:
    """Records of the pattern's named groups; missing where it doesn't match. A group that takes no part is empty."""
    names = re.findall(r"\(\?P?<([A-Za-z][A-Za-z0-9_]*)>", pattern)
    if not names:
        raise ValueError("extract_regex: the pattern has no named groups")
    groups = {n: _group_number(pattern, n) for n in names}
    whole = re.sub(r"\(\?P?<([A-Za-z][A-Za-z0-9_]*)>", lambda m: f"(?<{m[1].replace('_', 'U95')}>", pattern)
    fn = lambda s: F.when(F.rlike(s, F.lit(whole)), F.struct(*[F.regexp_extract(s, whole, k).alias(n) for n, k in groups.items()]))
    made = _each(array, fn, None, "extract_regex")
    from ragtide.operators.node import of_type

    return array.of(of_type(made.node.col, made.dtype))


def _group_number(pattern: str, name: str) -> int:
    """By Python's rules, which count groups as Java's do."""
    return re.compile(re.sub(r"\(\?<(?=[A-Za-z])", "(?P<", pattern)).groupindex[name]


def is_in(array: Array, value_set: Any, skip_nones: bool = False) -> Array:
    values = _values(value_set, skip_nones)
    has_none = any(v is None for v in values)
    plain = [v for v in values if v is not None]

    def fn(s: Column) -> Column:
        found = s.isin(plain) if plain else F.lit(False)
        return F.when(s.isNull(), F.lit(has_none and not skip_nones)).otherwise(found)

    return _each(array, fn, _BOOL, "is_in")


def index_in(array: Array, value_set: Any, skip_nones: bool = False) -> Array:
    """Places in the value set; missing where it isn't there."""
    values = _values(value_set, False)
    where = {}
    for i, v in enumerate(values):
        where.setdefault(v, i)

    def fn(s: Column) -> Column:
        known = [x for k, v in where.items() if k is not None for x in (F.lit(k), F.lit(v).cast("bigint"))]
        found = F.try_element_at(F.create_map(*known), s) if known else F.lit(None).cast("bigint")
        return F.when(s.isNull(), F.lit(where[None]).cast("bigint")).otherwise(found) if None in where and not skip_nones else F.when(s.isNotNull(), found)

    return _each(array, fn, _LONG, "index_in")


def _values(value_set: Any, skip_nones: bool) -> list:
    if isinstance(value_set, Array | Scalar):
        raise TypeError("the value set is a concrete list")
    return [v for v in value_set if not (skip_nones and v is None)]


# Change.
def length(array: Array) -> Array:
    return _each(array, lambda s: F.char_length(s).cast("bigint"), _LONG, "length")


def reverse(array: Array) -> Array:
    return _each(array, F.reverse, _STRING, "reverse")


def repeat(array: Array, num_repeats: Any) -> Array:
    return _each(array, lambda s, n: F.call_function("repeat", s, n.cast("int")), _STRING, "repeat", num_repeats)


def _pad_char(padding: str) -> str:
    if len(padding) != 1:
        raise ValueError("padding is one character")
    return padding


def lpad(array: Array, width: int, padding: str = " ") -> Array:
    return _each(array, lambda s: F.when(F.char_length(s) >= width, s).otherwise(F.lpad(s, width, _pad_char(padding))), _STRING, "lpad")


def rpad(array: Array, width: int, padding: str = " ") -> Array:
    return _each(array, lambda s: F.when(F.char_length(s) >= width, s).otherwise(F.rpad(s, width, _pad_char(padding))), _STRING, "rpad")


def center(array: Array, width: int, padding: str = " ") -> Array:
    def fn(s: Column) -> Column:
        left = F.char_length(s) + F.floor((F.lit(width) - F.char_length(s)) / 2).cast("int")
        return F.when(F.char_length(s) >= width, s).otherwise(F.rpad(F.lpad(s, left, F.lit(_pad_char(padding))), width, padding))

    return _each(array, fn, _STRING, "center")


def _strip(name: str, ends: tuple[bool, bool], chars: str | None) -> str:
    cls = r"\s" if chars is None else "[" + "".join(f"\\x{{{ord(c):x}}}" for c in chars) + "]"
    return ("(?U)" if chars is None else "") + "|".join(([rf"\A{cls}+"] if ends[0] else []) + ([rf"{cls}+\z"] if ends[1] else []))


def _trim(name: str, array: Array, ends: tuple[bool, bool], chars: str | None) -> Array:
    if chars == "":
        return array
    if chars is not None:
        fn = {(True, True): F.btrim, (True, False): F.ltrim, (False, True): F.rtrim}[ends]
        return _each(array, lambda s: fn(s, F.lit(chars)), _STRING, name)
    return _each(array, lambda s: F.regexp_replace(s, _strip(name, ends, chars), ""), _STRING, name)


def trim(array: Array, characters: str) -> Array:
    return _trim("trim", array, (True, True), characters)


def ltrim(array: Array, characters: str) -> Array:
    return _trim("ltrim", array, (True, False), characters)


def rtrim(array: Array, characters: str) -> Array:
    return _trim("rtrim", array, (False, True), characters)


def trim_whitespace(array: Array) -> Array:
    return _trim("trim_whitespace", array, (True, True), None)


def ltrim_whitespace(array: Array) -> Array:
    return _trim("ltrim_whitespace", array, (True, False), None)


def rtrim_whitespace(array: Array) -> Array:
    return _trim("rtrim_whitespace", array, (False, True), None)


def _place(x: int | None, default: Column, n: Column) -> Column:
    return default if x is None else F.least(F.lit(x), n) if x >= 0 else F.greatest(F.lit(0), n + x)


def slice(array: Array, start: int, stop: int | None = None, step: int = 1) -> Array:
    """As Python slices strings."""
    if step == 0:
        raise ValueError("the step can't be 0")

    def fn(s: Column) -> Column:
        n = F.char_length(s)
        if step > 0:
            a, b = _place(start, F.lit(0), n), _place(stop, n, n)
            part = F.substring(s, a + 1, F.greatest(F.lit(0), b - a))
            return part if step == 1 else F.array_join(F.filter(F.split(part, ""), lambda c, i: i % step == 0), "")
        from ragtide.operators.indexing import list_slice

        return F.array_join(let([F.split(s, "")], lambda c: list_slice(c, builtins.slice(start, stop, step))), "")

    return _each(array, fn, _STRING, "slice")


def replace_slice(array: Array, start: int, stop: int, replacement: str) -> Array:
    def fn(s: Column) -> Column:
        n = F.char_length(s)
        a = _place(start, F.lit(0), n)
        b = F.greatest(a, _place(stop, n, n))
        return F.concat(F.substring(s, F.lit(1), a), F.lit(replacement), F.substr(s, b + 1))

    return _each(array, fn, _STRING, "replace_slice")


def replace_substring(array: Array, pattern: str, replacement: str, max_replacements: int | None = None) -> Array:
    if max_replacements is None or max_replacements < 0:
        return _each(array, lambda s: F.replace(s, F.lit(pattern), F.lit(replacement)), _STRING, "replace_substring")
    if max_replacements == 0:
        return array
    return _each(array, lambda s: F.array_join(F.split(s, _quoted(pattern), max_replacements + 1), replacement), _STRING, "replace_substring")


def replace_substring_regex(array: Array, pattern: str, replacement: str, max_replacements: int | None = None) -> Array:
    r"""The replacement can name groups, as \1 or $1. With a limit the matches are put back one by one, each by the
    pattern itself, so that what stands between them is never looked at again."""
    whole, new = _regex(pattern), re.sub(r"\\(\d)", r"$\1", replacement)
    if max_replacements is None or max_replacements < 0:
        return _each(array, lambda s: F.regexp_replace(s, whole, new), _STRING, "replace_substring_regex")
    if max_replacements == 0:
        return array

    def fn(s: Column) -> Column:
        rest = F.get(F.split(s, whole, max_replacements + 1), F.lit(max_replacements))
        head = F.substring(s, F.lit(1), F.char_length(s) - F.coalesce(F.char_length(rest), F.lit(0)))
        return F.concat(F.regexp_replace(head, whole, new), F.coalesce(rest, F.lit("")))

    return _each(array, fn, _STRING, "replace_substring_regex")


# Splitting and joining.
def _splits(array: Array, pattern: str, max_splits: int | None, reverse: bool, name: str) -> Array:
    n = -1 if max_splits is None or max_splits < 0 else max_splits + 1

    def fn(s: Column) -> Column:
        if not reverse or n < 0:
            return F.split(s, pattern, n)
        # From the end: all parts, of which the first ones are put together again with what stood between them.
        return let([F.split(s, pattern, -1), F.regexp_extract_all(s, F.lit(pattern), F.lit(0))], backwards)

    def backwards(parts: Column, seps: Column) -> Column:
        tail = F.slice(parts, F.size(parts) - max_splits + 1, max_splits) if max_splits else F.slice(parts, 1, 0)
        cut = F.size(parts) - 1 - max_splits
        head = F.array_join(F.transform(F.slice(parts, 1, cut + 1), lambda p, i: F.concat(p, F.when(i < cut, F.get(seps, i)).otherwise(F.lit("")))), "")
        return F.when(cut <= 0, parts).otherwise(F.concat(F.array(head), tail))

    made = _each(array, fn, None, name)
    return Array(made.frame, Leaf(made.node.col, made.depth + 1, made.node.skel + fresh(1)))


def split_pattern(array: Array, pattern: str, max_splits: int | None = None, reverse: bool = False) -> Array:
    return _splits(array, _quoted(pattern), max_splits, reverse, "split_pattern")


def split_pattern_regex(array: Array, pattern: str, max_splits: int | None = None, reverse: bool = False) -> Array:
    if reverse:
        raise NotImplementedError("split_pattern_regex can't split from the end")
    return _splits(array, _regex(pattern), max_splits, False, "split_pattern_regex")


def split_whitespace(array: Array, max_splits: int | None = None, reverse: bool = False) -> Array:
    return _splits(array, r"(?U)\s+", max_splits, reverse, "split_whitespace")


def join(array: Array, separator: Any) -> Array:
    """The strings of each innermost list as one."""
    if not array.depth:
        raise TypeError("str.join: lists of strings are needed")
    frame, (array, sep) = aligned(array, separator, name="str.join")
    other = sep if isinstance(sep, Array) else None
    fn = lambda a, s: F.when(F.forall(a, lambda v: v.isNotNull()), F.array_join(a, s))
    d = array.depth - 1
    if other is None:
        col = lift(lambda a: fn(a, sep), [array.node.col], [d])
    else:
        # array_join takes a constant separator: the parts are put together one by one.
        glue = lambda a, s: F.when(F.forall(a, lambda v: v.isNotNull()), F.aggregate(a, F.struct(F.lit("").alias("t"), F.lit(False).alias("n")), lambda acc, v: F.struct(F.concat(acc["t"], F.when(acc["n"], s).otherwise(F.lit("")), v).alias("t"), F.lit(True).alias("n")), lambda acc: acc["t"]))
        col = lift(glue, [array.node.col, other.node.col], [d, other.depth])
    return Array(frame, Leaf(col, d, array.node.skel[:d]))


def join_element_wise(*arrays: Any) -> Array:
    """Strings of all arrays but the last, joined by the last one's."""
    if len(arrays) < 2:
        raise TypeError("str.join_element_wise: two arrays are needed at least")

    def fn(*cols: Column) -> Column:
        *parts, sep = cols
        out = parts[0]
        for p in parts[1:]:
            out = F.concat(out, sep, p)
        return out

    return elementwise(fn, *arrays, name="str.join_element_wise", dtype=_STRING)


def to_categorical(array: Array) -> Array:
    """Marks strings as categories. Their values stay; Parquet stores repeated strings once by itself."""
    from ragtide.operators.structure import with_parameter

    return with_parameter(array, "categorical", True)
