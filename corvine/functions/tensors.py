"""Column -> Column functions for targets and small tensors; no Python UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: kbar to eV/Angstrom^3: 1e8 J/m^3, 1.6021766208e-19 J/eV, 1e30 A^3/m^3
KBAR = 6.241509125883257e-4

#: The elements' symbols by atomic number, from 1: fixed values.
SYMBOLS = (
    "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe "
    "Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr Rf Db Sg "
    "Bh Hs Mt Ds Rg Cn Nh Fl Mc Lv Ts Og"
).split()


def atomic_number(symbol: Column) -> Column:
    """The number of an element's symbol; null for another text."""
    place = F.array_position(F.array(*map(F.lit, SYMBOLS)), symbol)
    return F.when(place > 0, place.cast("int"))


def voigt_to_matrix(v: Column) -> Column:
    """xx, yy, zz, yz, xz, xy to a symmetric 3x3 matrix."""
    at = lambda i: F.get(v, i)
    return F.array(F.array(at(0), at(5), at(4)), F.array(at(5), at(1), at(3)), F.array(at(4), at(3), at(2)))


def voigt_to_nine(v: Column) -> Column:
    return F.flatten(voigt_to_matrix(v))


def matrix_from_any(v: Column) -> Column:
    """A flat array of 6 (Voigt) or 9 numbers to 3x3; any other size raises."""
    rows = F.array(*(F.slice(v, i, 3) for i in (1, 4, 7)))
    return F.when(v.isNull(), None).when(F.size(v) == 6, voigt_to_matrix(v)).when(F.size(v) == 9, rows).otherwise(F.raise_error(F.lit("stress needs 6 or 9 numbers")))


def stress_from_kbar(voigt: Column, matrix: Column, factor: float = KBAR) -> Column:
    """Voigt-6, else 3x3, times ``factor``, no change of sign; other shapes raise."""
    square = (F.size(matrix) == 3) & F.forall(matrix, lambda r: F.size(r) == 3)
    m = F.when(F.size(voigt) == 6, voigt_to_matrix(voigt)).when(F.coalesce(square, F.lit(False)), matrix).otherwise(F.raise_error(F.lit("stress needs 6 numbers or 3x3")))
    return F.transform(m, lambda row: F.transform(row, lambda x: x * factor))


def reshape_n3(flat: Column, n: Column) -> Column:
    """3n numbers to n rows of three; another size raises."""
    rows = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(flat, 3 * i + 1, 3))).otherwise(F.array().cast("array<array<double>>"))
    return F.when(F.size(flat) == 3 * n, rows).otherwise(F.raise_error(F.lit("forces need three numbers an atom")))


def resolve_target(keys: list[str], info: Column, arrays: Column, calculated: Column) -> Column:
    """The first of: for each key info, then arrays; then the calculator's value. Null counts as absent; none of them raises."""
    found = [F.try_element_at(m, F.lit(k)) for k in keys for m in (info, arrays)]
    return F.coalesce(*found, calculated, F.raise_error(F.concat(F.lit("no target under "), F.lit(", ".join(keys)))))


def try_number(text: Column) -> Column:
    return F.trim(text).try_cast("double")


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(text, r"\x1b\[[0-9;?]*[A-Za-z]|\r", "")


def label_and_path(argument: Column) -> tuple[Column, Column]:
    """LABEL=path at the first '='; else the file's stem and the whole."""
    has = F.contains(argument, F.lit("="))
    name = F.element_at(F.split(argument, "/"), -1)
    stem = F.when(F.length(F.regexp_replace(name, r"\.[^.]*$", "")) > 0, F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)
    return F.when(has, F.substring_index(argument, "=", 1)).otherwise(stem), F.when(has, F.regexp_replace(argument, "^[^=]*=", "")).otherwise(argument)


def gpus(resource: Column) -> Column:
    """GPUs of a resource string: the last field of its first gpu item, 1 if that is no number, 0 without an item."""
    item = F.get(F.filter(F.transform(F.split(resource, ","), lambda x: F.trim(x)), lambda x: F.get(F.split(x, ":"), 0) == "gpu"), 0)
    fields = F.split(item, ":")
    return F.when(item.isNull(), 0).when(F.size(fields) == 1, 1).otherwise(F.coalesce(F.element_at(fields, -1).try_cast("int"), F.lit(1)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def is_record(*required: Column) -> Column:
    out = F.lit(True)
    for c in required:
        out = out & c.isNotNull()
    return out
