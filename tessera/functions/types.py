"""Element types, their promotion lattice, and casts that wrap instead of failing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: name -> (kind, bits, Spark type). Unsigned types live in the next wider signed one.
DTYPES = {
    "bool": ("b", 1, "boolean"),
    "int8": ("i", 8, "tinyint"),
    "int16": ("i", 16, "smallint"),
    "int32": ("i", 32, "int"),
    "int64": ("i", 64, "bigint"),
    "uint8": ("u", 8, "smallint"),
    "uint16": ("u", 16, "int"),
    "uint32": ("u", 32, "bigint"),
    "uint64": ("u", 64, "decimal(20,0)"),
    "float32": ("f", 32, "float"),
    "float64": ("f", 64, "double"),
    "complex128": ("c", 128, "struct<re:double,im:double>"),
    "str": ("s", 0, "string"),
}
KINDS = "biufcs"


def promote(a: str, b: str) -> str:
    """The smallest type that holds both, as arrays of these types combine."""
    if a == b:
        return a
    (ka, na, _), (kb, nb, _) = DTYPES[a], DTYPES[b]
    kinds = {ka, kb}
    if "s" in kinds:
        return "str"
    if "c" in kinds:
        return "complex128"
    if ka == "b":
        return b
    if kb == "b":
        return a
    if "f" in kinds:
        if ka == kb:
            return f"float{max(na, nb)}"
        bits, other = (na, nb) if ka == "f" else (nb, na)
        return "float32" if bits == 32 and other <= 16 else "float64"
    if ka == kb:
        return a if na >= nb else b
    signed, unsigned = (na, nb) if ka == "i" else (nb, na)
    wide = signed if signed > unsigned else 2 * unsigned
    return f"int{wide}" if wide <= 64 else "float64"


def sum_type(dtype: str) -> str:
    """Type in which a sum accumulates: small integers widen to 64 bits."""
    kind = DTYPES[dtype][0]
    return "int64" if kind in "bi" else "uint64" if kind == "u" else dtype


def can_cast(a: str, b: str, casting: str = "safe") -> bool:
    ka, kb = DTYPES[a][0], DTYPES[b][0]
    if casting == "unsafe":
        return True
    if casting == "no":
        return a == b
    if casting == "same_kind" and (ka == kb or ka in "bui" and "bui".find(ka) <= "bui".find(kb) or kb in "fc" and ka in "biuf"):
        return True
    return promote(a, b) == b


def wrap(value: Column, dtype: str) -> Column:
    """Integers modulo the type's width; floats lose their fraction first."""
    kind, bits, spark = DTYPES[dtype]
    if kind == "b":
        return value.cast("double") != 0
    if kind not in "iu":
        return value.cast(spark)
    whole = value.cast("decimal(38,0)") if bits == 64 else value.cast("bigint").cast("decimal(38,0)")
    span = F.lit(2**bits).cast("decimal(38,0)")
    positive = ((whole % span) + span) % span
    if kind == "u":
        return positive.cast(spark)
    half = F.lit(2 ** (bits - 1)).cast("decimal(38,0)")
    return F.when(positive >= half, positive - span).otherwise(positive).cast(spark)


def result_type(*dtypes: str) -> str:
    """The type in which arrays of all these types combine, whatever their order."""
    out = dtypes[0]
    for dtype in sorted(dtypes[1:], key=lambda d: (KINDS.index(DTYPES[d][0]), DTYPES[d][1])):
        out = promote(out, dtype)
    return out


def min_scalar_type(value: bool | int | float | complex | str) -> str:
    """The smallest type that holds one value; whole numbers of no sign are unsigned."""
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int):
        kind, bits = ("uint", value.bit_length()) if value >= 0 else ("int", (~value).bit_length() + 1)
        for width in (8, 16, 32, 64):
            if bits <= width:
                return f"{kind}{width}"
        raise OverflowError(f"{value} is beyond 64 bits")
    if isinstance(value, float):
        return "float32" if value != value or abs(value) in (0.0, float("inf")) or abs(value) < 3.4028235677973366e38 else "float64"
    return "complex128" if isinstance(value, complex) else "str"


#: abstract kind -> kinds of types below it.
ABSTRACT = {"generic": "biufcs", "number": "iufc", "integer": "iu", "signedinteger": "i", "unsignedinteger": "u", "inexact": "fc", "floating": "f", "complexfloating": "c", "bool_": "b", "flexible": "s", "character": "s", "str_": "s"}
#: kind of the array interface standard -> abstract kind.
STANDARD = {"bool": "bool_", "signed integer": "signedinteger", "unsigned integer": "unsignedinteger", "integral": "integer", "real floating": "floating", "complex floating": "complexfloating", "numeric": "number"}


def issubdtype(dtype: str, above: str) -> bool:
    return dtype == above or above in ABSTRACT and DTYPES[dtype][0] in ABSTRACT[above]


def isdtype(dtype: str, kinds: str | tuple[str, ...]) -> bool:
    """Whether a type is of one of the kinds, named as in the array standard, or one of the types themselves."""
    return any(dtype == k or k in STANDARD and issubdtype(dtype, STANDARD[k]) for k in (kinds if isinstance(kinds, tuple) else (kinds,)))


def common_type(*dtypes: str) -> str:
    """The inexact type for arrays of these types; whole numbers count as float64."""
    return result_type(*["float64" if DTYPES[d][0] in "biu" else d for d in dtypes])


def dtype_of(frame, column: str) -> str | None:
    """Element type of a column, None where it is of no type here; each Spark type stands for its signed type."""
    spark = frame.schema[column].dataType.simpleString()
    return next((name for name, (kind, _, made) in DTYPES.items() if made == spark and kind != "u" or made == spark == "decimal(20,0)"), None)
