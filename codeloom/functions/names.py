"""Column expressions over identifiers, qualified names and signatures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def short_id(*parts: Column | str) -> Column:
    """First 16 hexadecimal digits of the SHA-256 of the parts, joined by bars."""
    return F.substring(F.sha2(F.concat_ws("|", *(F.col(p) if isinstance(p, str) else p for p in parts)), 256), 1, 16)


def node_id(kind: Column, repo: Column, file: Column, qualified_name: Column) -> Column:
    return F.concat_ws(":", kind, repo, file, qualified_name)


def owner_of(name: Column) -> Column:
    """``pkg.Owner`` of ``pkg.Owner#member(...)``; a type is its own owner."""
    return F.substring_index(name, "#", 1)


def member_name(name: Column) -> Column:
    """``member`` of ``Owner#member(A,B)``, null for a type."""
    return F.nullif(F.regexp_extract(name, r"#([^(]+)", 1), F.lit(""))


def split_types(inner: Column) -> Column:
    """Type names of a parameter list without its brackets; none for a blank one."""
    return F.when(F.trim(inner) == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(inner, ","), F.trim))


def param_types(name: Column) -> Column:
    """``[A, B]`` of ``Owner#member(A,B)``, null without brackets."""
    return F.when(name.contains("("), split_types(F.regexp_extract(name, r"\(([^)]*)\)", 1)))


def return_type(signature: Column) -> Column:
    """``Ret`` of ``Ret name(...)``, erased, null for a constructor or a type."""
    head = F.trim(F.substring_index(signature, "(", 1))
    return F.when(signature.contains("(") & head.contains(" "), erased(F.regexp_replace(head, r"\s+\S+$", "")))


def erased(name: Column) -> Column:
    """Simple name of a type: without type arguments, array brackets and qualifiers."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(name), r"<.*>", ""), r"[\[\] ]+$", "")
    return F.trim(F.substring_index(bare, ".", -1))


def enclosing_types(owner: Column) -> Column:
    """``[a.B.C, a.B, a]`` of ``a.B.C``: innermost first."""
    parts = F.split(owner, r"\.")
    return F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "."))


def search_terms(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def word_parts(name: Column) -> Column:
    """Distinct lower-case words of a camelCase, snake_case or dotted name.

    A word ends before a capital that follows a small letter, before the last of several capitals if a small letter follows
    that, between letters and digits, and at any other character.
    """
    ends = r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])"
    words = F.split(F.lower(F.regexp_replace(name, ends, " ")), "[^a-z0-9]+")
    return F.array_distinct(F.filter(words, lambda w: w != ""))


def normal_signature(member: Column) -> Column:
    """``name(A,B)`` with erased parameter types and no spaces; a bare name stays."""
    types = F.transform(param_types(member), lambda t: erased(t))
    return F.when(member.contains("("), F.concat(F.trim(F.substring_index(member, "(", 1)), F.lit("("), F.array_join(types, ","), F.lit(")"))).otherwise(F.trim(member))


#: Letters of JVM descriptors.
JVM_TYPES = {"B": "byte", "C": "char", "D": "double", "F": "float", "I": "int", "J": "long", "S": "short", "Z": "boolean"}


def descriptor_types(descriptor: Column) -> Column:
    """Simple type names of the parameters of a JVM descriptor such as ``(ILjava/lang/String;)V``; null if it is malformed."""
    inner = F.regexp_extract(descriptor, r"^\(([^)]*)\)", 1)
    found = F.regexp_extract_all(inner, F.lit(r"\[*(?:L[^;]+;|[BCDFIJSZ])"), F.lit(0))
    names = F.create_map(*(F.lit(x) for kv in JVM_TYPES.items() for x in kv))

    def simple(t: Column) -> Column:
        t = F.regexp_replace(t, r"^\[+", "")
        last = F.regexp_replace(F.regexp_replace(t, r"^L(?:.*/)?|;$", ""), r"^.*\$", "")
        return F.when(t.startswith("L"), last).otherwise(names[t])

    return F.when(descriptor.startswith("(") & (F.array_join(found, "") == inner), F.transform(found, simple))
