"""Tables of a graph, as DDL, and their fixed vocabularies."""

from __future__ import annotations

NODES = "id string, name string, kind string, file_path string, line int, end_line int, metadata map<string,string>, seq long"
EDGES = "edge_id long, src string, dst string, relation string"
FILES = "path string, content string, mtime timestamp, sha256 string, lang string, seq long"
RULES = "ord int, from string, to string, description string"
KINDS = ("file", "component", "function", "class", "interface", "type", "variable", "api_endpoint")
RELATIONS = ("imports", "calls", "contains", "implements", "extends")
MODULE_KINDS = ("file", "component")

# Extensions that are indexed, in the order in which they are tried, and directories that are not entered.
EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".vue", ".svelte", ".py", ".go", ".rs", ".java")
IGNORED_DIRECTORIES = ("node_modules", "dist", "lib", "build", "coverage", "__pycache__", "venv", "target", "vendor")  # and all that start with a dot
LANGUAGES = {
    ".ts": "typescript", ".tsx": "typescript", ".js": "typescript", ".jsx": "typescript", ".mjs": "typescript", ".cjs": "typescript",
    ".vue": "sfc", ".svelte": "sfc", ".py": "python", ".go": "go", ".rs": "rust", ".java": "java",
}
