"""Column functions on slash-separated paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Directories of third-party code. Fixed values.
VENDORED = ("vendor", "third_party", "node_modules")


def dirname(path: Column) -> Column:
    """The path without its last segment; empty for a single segment."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def ancestors(path: Column) -> Column:
    """All directories above a path, the nearest first, and at last the root (the empty string)."""
    parts = F.split(dirname(path), "/")
    n = F.size(parts)
    return F.when(dirname(path) == "", F.array(F.lit(""))).otherwise(
        F.concat(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.slice(parts, 1, n - i), "/")), F.array(F.lit("")))
    )


def role(path: Column, test: str, tooling: str) -> Column:
    """production, test or tooling by patterns; test beats tooling."""
    return F.when(path.rlike(test), "test").when(path.rlike(tooling), "tooling").otherwise("production")


def origin(path: Column, content: Column | None = None, generated: str = r"(?im)^\s*(?://|/\*|#|--|<!--|\*).*(?:@generated|code generated|do not edit|autogenerated)") -> Column:
    """vendored by directory, generated by a marker in a comment line, else authored."""
    vendored = path.rlike(rf"(?:^|/)(?:{'|'.join(VENDORED)})/")
    out = F.when(vendored, "vendored")
    return (out.when(content.rlike(generated), "generated") if content is not None else out).otherwise("authored")


def glob_to_regex(glob: str) -> str:
    """`**` crosses directories, `*` and `?` don't; braces are alternatives."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "{" and "}" in glob[i:]:
            end = glob.index("}", i)
            out, i = out + "(?:" + "|".join(glob_to_regex(x)[1:-1] for x in glob[i + 1 : end].split(",")) + ")", end + 1
        else:
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(c, "\\" + c if c in r"\.^$+()[]|{}" else c), i + 1
    return f"^{out}$"
