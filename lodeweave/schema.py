"""The canonical relations, as Spark schemas.

Confidence is an ordered byte: 0 possible, 1 probable, 2 certain. Visibility scopes are ordered and nested: 0 file, 1 unit,
2 module, 3 package, 4 public. Natural string keys identify files and symbols, so that nothing depends on row numbers.
"""

from __future__ import annotations

POSSIBLE, PROBABLE, CERTAIN = 0, 1, 2
CONFIDENCE = ("possible", "probable", "certain")
FILE, UNIT, MODULE, PACKAGE, PUBLIC = range(5)
#: Root kinds in the order of precedence, with the colour that each gives.
ROOT_KINDS = ("production", "test", "tooling")
COLORS = {"production": "production", "test": "test-only", "tooling": "tooling-only"}

SPAN = "struct<sl:int,sc:int,el:int,ec:int>"
FILES = f"path string, content_hash string, language string, role string, origin string, package string, unit string, unit_parent string, test_spans array<{SPAN}>"
SYMBOLS = f"sym string, path string, name string, kind string, span {SPAN}, exported boolean, visibility int, member_of string, signature_span {SPAN}, implicitly_invoked boolean, nested_scope boolean, visibility_inherited boolean, visible_in_unit string, implements string, markers array<string>"
EDGES = f"ekind string, src string, dst string, ref_kind string, confidence int, span {SPAN}, owner string, source string"
ROOTS = "kind string, node string, confidence int, source string"
SHAPES = f"sym string, shape_ordinal int, shape_span {SPAN}, cyclomatic int, loc int, token_count int, fingerprints array<bigint>, body_is_construction boolean"
PACKAGES = "package string, manifest string, name string, private boolean, declares_surface boolean, surface array<string>, resolves_dependency_usage boolean, claim_languages array<string>"
DECLARED = "package string, manifest string, name string, version_req string, scope string, ordinal int"
SCRIPT_DEPS = "package string, name string"
COVERAGE = "path string, line int, hits bigint"
PRAGMAS = f"path string, span {SPAN}, category string, subject string, scope string"
FINDINGS = "id string, category string, subject_kind string, severity int, confidence int, path string, line int, symbol string, package string, message string"
LADDER = "language string, idx int, scope int, label string, surface_transitive boolean"

#: Finding categories by group. Fixed values.
GROUPS = {
    "dead-code": ("unused", "test-only"),
    "dependencies": ("unresolved", "undeclared", "version-skew"),
    "structure": ("cyclic", "deep-import", "internal-only", "private-type-leak"),
    "risk": ("crap", "untested", "duplicate"),
    "hygiene": ("stale",),
}
CATEGORIES = tuple(c for g in GROUPS.values() for c in g)
#: Severity ranks: the gate compares them.
INFO, WARNING, ERROR = 0, 1, 2
SEVERITY = {"unresolved": ERROR, "unused": WARNING, "version-skew": WARNING, "undeclared": WARNING, "deep-import": WARNING, "cyclic": WARNING, "crap": WARNING}
