"""Imports and declarations of source texts, line by line, with comments and strings masked."""

from __future__ import annotations

import re

# Comments and texts over several lines of each language, and what begins a line that imports or declares.
MASKS = {
    "js": re.compile(r"//[^\n]*|/\*.*?\*/|`(?:\\.|[^`\\])*`", re.S),
    "python": re.compile(r"\"\"\".*?\"\"\"|'''.*?'''|#[^\n]*", re.S),
    "powershell": re.compile(r"<#.*?#>|#[^\n]*", re.S),
}
RULES = {
    "js": [("import", r"^\s*import\s+(?:[^'\"]*?\s+from\s+)?['\"]([^'\"]+)['\"]"), ("import", r"\brequire\(\s*['\"]([^'\"]+)['\"]\s*\)"), ("export", r"^\s*export\s+[^'\"]*\s+from\s+['\"]([^'\"]+)['\"]"),
           ("decl", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*([A-Za-z_$][\w$]*)"), ("decl", r"^\s*(?:export\s+)?(?:default\s+)?class\s+([A-Za-z_$][\w$]*)"), ("decl", r"^(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)")],
    "python": [("import", r"^\s*import\s+([\w.]+)"), ("import", r"^\s*from\s+([\w.]+)\s+import\b"), ("decl", r"^\s*(?:async\s+)?def\s+(\w+)"), ("decl", r"^\s*class\s+(\w+)")],
    "powershell": [("decl", r"(?i)^\s*function\s+([\w:-]+)"), ("import", r"^\s*\.\s+[\"']?([^\s\"']+\.ps1)"), ("import", r"(?i)^\s*Import-Module\s+[\"']?([^\s\"']+)")],
}
RULES = {k: [(kind, re.compile(p)) for kind, p in v] for k, v in RULES.items()}


def masked(text: str, lang: str) -> str:
    """Comments (and texts over several lines) as spaces; line breaks stay."""
    return MASKS[lang].sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)


def facts(text: str, lang: str) -> list[tuple[int, str, str]]:
    return [(n, kind, m[1]) for n, line in enumerate(masked(text, lang).split("\n"), 1) for kind, rule in RULES[lang] for m in rule.finditer(line)]
