"""Element-wise functions, by the names NumPy gives its ufuncs.

Division and logarithms follow IEEE 754, whatever Spark's ANSI setting: 1/0 is infinite, 0/0 and log(-1) are NaN. NaN
compares false with everything, itself included. Remainders take the sign of the divisor. Integer floor division and
remainder by zero give 0. A missing value on either side gives a missing value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragtide.operators.array import Array, Scalar, elementwise

_NAN, _INF = float("nan"), float("inf")
_WHOLE = T.ByteType | T.ShortType | T.IntegerType | T.LongType


def _d(x: Column) -> Column:
    return x.cast("double")


def _divide(a: Column, b: Column) -> Column:
    a, b = _d(a), _d(b)
    zero = F.when(F.isnan(a) | (a == 0), F.lit(_NAN)).when((a > 0) == (b.cast("string") != "-0.0"), F.lit(_INF)).otherwise(F.lit(-_INF))
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when(b == 0, zero).otherwise(F.try_divide(a, b))


def _floor_divide(a: Column, b: Column) -> Column:
    quotient = _divide(a, b)
    return F.when(quotient.isNull() | F.isnan(quotient) | (F.abs(quotient) == _INF), quotient).otherwise(quotient - _mod_double(quotient, F.lit(1.0)))


def _mod_double(a: Column, b: Column) -> Column:
    rest = F.try_mod(_d(a), _d(b))
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when(_d(b) == 0, F.lit(_NAN)).when((rest != 0) & ((rest < 0) != (_d(b) < 0)), rest + _d(b)).otherwise(rest)


def _mod(a: Column, b: Column) -> Column:
    rest = F.try_mod(a, b)
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when(b == 0, F.lit(0)).when((rest != 0) & ((rest < 0) != (b < 0)), rest + b).otherwise(rest)


def _floor_whole(a: Column, b: Column) -> Column:
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when(b == 0, F.lit(0)).otherwise(F.try_divide(a - _mod(a, b), b)).cast("bigint")


def _nan_safe(fn: Callable[[Column, Column], Column], side: int = 0) -> Callable[[Column, Column], Column]:
    """Spark takes NaN for the largest value, and for equal to itself: it is told apart on the side where that matters.
    The comparison itself stays a conjunct of its own, which filters hand down to the scan."""

    def compare(a: Column, b: Column) -> Column:
        x, y = (a, b) if side == 0 else (b, a)
        return fn(a, b) & F.when(F.isnan(x), F.when(y.isNotNull(), F.lit(False))).otherwise(F.lit(True))

    return compare


def _unequal(a: Column, b: Column) -> Column:
    return (a != b) | (F.isnan(a) & F.isnan(b))


def _log(fn: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda a: F.when(_d(a) == 0, F.lit(-_INF)).when(_d(a) < 0, F.lit(_NAN)).otherwise(fn(_d(a)))


def _truth(a: Column) -> Column:
    return a.cast("boolean")


class Function:
    """Calls as f(array, ...). kernel works on columns; whole and floats are chosen by the operands' types."""

    def __init__(self, name: str, kernel: Callable[..., Column], arity: int, dtype: T.DataType | None = None, whole: Callable[..., Column] | None = None, floats: Callable[..., Column] | None = None, bools: Callable[..., Column] | None = None):
        self.__name__, self.kernel, self.arity, self.dtype, self.whole, self.floats, self.bools = name, kernel, arity, dtype, whole, floats, bools

    def __call__(self, *items):
        if len(items) != self.arity:
            raise TypeError(f"{self.__name__} takes {self.arity} operands, not {len(items)}")
        if not any(isinstance(x, Array | Scalar) for x in items):
            raise TypeError(f"{self.__name__}: no lazy array among the operands")
        for x in items:
            if isinstance(x, list | tuple | dict) or type(x).__name__ == "ndarray" and x.ndim:
                raise TypeError(f"{self.__name__}: concrete arrays can't be mixed with lazy ones; make them lazy first")
        if not any(isinstance(x, Array) for x in items):
            first = next(x for x in items if isinstance(x, Scalar))
            return first._with(lambda a, b: self.kernel(a) if self.arity == 1 else self.kernel(a, b), None if self.arity == 1 else items[1])
        kinds = [_kind(x) for x in items]
        kernel, dtype = self.kernel, self.dtype
        if self.whole and all(k in ("whole", "bool") for k in kinds):
            kernel = self.whole
        elif self.bools and all(k == "bool" for k in kinds):
            kernel = self.bools
        elif self.floats and any(k == "float" for k in kinds):
            kernel = self.floats
        return elementwise(kernel, *items, name=self.__name__, dtype=dtype)


def _kind(x) -> str:
    if isinstance(x, Array):
        if x.fields:
            return "record"
        kind = x.scalar_type
    elif isinstance(x, Scalar):
        kind = x.dtype
    else:
        return "bool" if isinstance(x, bool) else "whole" if isinstance(x, int) else "float" if isinstance(x, float) else "other"
    return "bool" if isinstance(kind, T.BooleanType) else "whole" if isinstance(kind, _WHOLE) else "float" if isinstance(kind, T.FloatType | T.DoubleType) else "other"


_BOOL, _DOUBLE = T.BooleanType(), T.DoubleType()
_all: dict[str, Function] = {}


def _make(name: str, kernel: Callable[..., Column], arity: int, dtype: T.DataType | None = None, **kinds) -> None:
    _all[name] = Function(name, kernel, arity, dtype, **kinds)


for _name, _fn in {"add": lambda a, b: a + b, "subtract": lambda a, b: a - b, "multiply": lambda a, b: a * b}.items():
    _make(_name, _fn, 2)
_make("true_divide", _divide, 2, _DOUBLE)
_make("divide", _divide, 2, _DOUBLE)
_make("floor_divide", _floor_divide, 2, whole=_floor_whole)
_make("mod", _mod_double, 2, whole=_mod)
_make("remainder", _mod_double, 2, whole=_mod)
_make("fmod", lambda a, b: F.when(_d(b) == 0, F.lit(_NAN)).otherwise(F.try_mod(_d(a), _d(b))), 2)
_make("power", lambda a, b: F.pow(a, b), 2, whole=lambda a, b: F.when(b >= 0, F.pow(a, b).cast("bigint")).otherwise(F.raise_error(F.lit("whole numbers to negative powers aren't whole"))))
_make("arctan2", lambda a, b: F.atan2(a, b), 2, _DOUBLE)
_make("hypot", lambda a, b: F.hypot(a, b), 2, _DOUBLE)
_make("maximum", lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b)), 2)
_make("minimum", lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.least(a, b)), 2, floats=lambda a, b: F.when(F.isnan(a) | F.isnan(b), F.lit(_NAN)).when(a.isNotNull() & b.isNotNull(), F.least(a, b)))
for _name, _fn in {"equal": lambda a, b: a == b, "less": lambda a, b: a < b, "less_equal": lambda a, b: a <= b, "greater": lambda a, b: a > b, "greater_equal": lambda a, b: a >= b}.items():
    _make(_name, _fn, 2, _BOOL, floats=_nan_safe(_fn, 1 if _name.startswith("less") else 0))
_make("not_equal", lambda a, b: a != b, 2, _BOOL, floats=_unequal)
_make("logical_and", lambda a, b: _truth(a) & _truth(b), 2, _BOOL)
_make("logical_or", lambda a, b: _truth(a) | _truth(b), 2, _BOOL)
_make("logical_xor", lambda a, b: _truth(a) != _truth(b), 2, _BOOL)
_make("logical_not", lambda a: ~_truth(a), 1, _BOOL)
_make("bitwise_and", lambda a, b: a.bitwiseAND(b), 2, bools=lambda a, b: a & b)
_make("bitwise_or", lambda a, b: a.bitwiseOR(b), 2, bools=lambda a, b: a | b)
_make("bitwise_xor", lambda a, b: a.bitwiseXOR(b), 2, bools=lambda a, b: a != b)
_make("invert", lambda a: F.bitwise_not(a), 1, bools=lambda a: ~a)


def _shift(name: str) -> Callable[[Column, Column], Column]:
    return lambda a, b: F.call_function(name, a.cast("bigint"), b.cast("int"))


_make("left_shift", _shift("shiftleft"), 2)
_make("right_shift", _shift("shiftright"), 2)
_make("negative", lambda a: -a, 1)
_make("positive", lambda a: a, 1)
_make("absolute", F.abs, 1)
_make("fabs", lambda a: F.abs(_d(a)), 1)
_make("sign", lambda a: F.signum(a), 1, whole=lambda a: F.signum(a).cast("int"), floats=lambda a: F.when(F.isnan(a), a).otherwise(F.signum(a)))
_make("square", lambda a: a * a, 1)
_make("reciprocal", lambda a: _divide(F.lit(1.0), a), 1, _DOUBLE)
_make("floor", lambda a: F.when(F.isnan(a) | (F.abs(a) >= 2.0**52), a).otherwise(F.floor(a).cast("double")), 1, whole=lambda a: a)
_make("ceil", lambda a: F.when(F.isnan(a) | (F.abs(a) >= 2.0**52), a).otherwise(F.ceil(a).cast("double")), 1, whole=lambda a: a)
_make("trunc", lambda a: F.when(F.isnan(a) | (F.abs(a) >= 2.0**52), a).otherwise(a.cast("bigint").cast("double")), 1, whole=lambda a: a)
_make("rint", F.rint, 1, _DOUBLE)
for _name, _fn in {"sqrt": F.sqrt, "cbrt": F.cbrt, "exp": F.exp, "expm1": F.expm1, "sin": F.sin, "cos": F.cos, "tan": F.tan, "arcsin": F.asin, "arccos": F.acos, "arctan": F.atan, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "arcsinh": F.asinh, "arccosh": F.acosh, "arctanh": F.atanh, "degrees": F.degrees, "radians": F.radians, "rad2deg": F.degrees, "deg2rad": F.radians}.items():
    _make(_name, lambda a, fn=_fn: fn(_d(a)), 1, _DOUBLE)
_make("exp2", lambda a: F.pow(F.lit(2.0), _d(a)), 1, _DOUBLE)
for _name, _fn in {"log": F.ln, "log2": F.log2, "log10": F.log10}.items():
    _make(_name, _log(_fn), 1, _DOUBLE)
_make("log1p", lambda a: F.when(_d(a) == -1, F.lit(-_INF)).when(_d(a) < -1, F.lit(_NAN)).otherwise(F.log1p(_d(a))), 1, _DOUBLE)
_make("isnan", lambda a: F.when(a.isNotNull(), F.isnan(_d(a))), 1, _BOOL)
_make("isinf", lambda a: F.abs(_d(a)) == _INF, 1, _BOOL, floats=lambda a: F.abs(_d(a)) == _INF)
_make("isfinite", lambda a: F.when(a.isNotNull(), ~F.isnan(_d(a)) & (F.abs(_d(a)) != _INF)), 1, _BOOL)
_make("signbit", lambda a: a < 0, 1, _BOOL, floats=lambda a: a.cast("string").startswith("-"))


def by_name(name: str) -> Function:
    if name not in _all:
        raise NotImplementedError(f"the ufunc {name} isn't known")
    return _all[name]


def known() -> list[str]:
    return sorted(_all)


def __getattr__(name: str) -> Function:
    if name in _all:
        return _all[name]
    raise AttributeError(name)
