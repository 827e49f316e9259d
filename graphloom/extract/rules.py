"""Vocabularies and patterns of the source languages, stated plainly: all values in this module are fixed values that
results depend on."""

from __future__ import annotations

GENERATED = ["generated", "generated-sources"]
SKIP_DIRS = ["__pycache__", "node_modules", ".venv", "venv", "env", ".git", "dist", "build", ".next", "out", "coverage", ".turbo", ".cache", "target", "vendor", ".expo"]

LANGUAGES = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".tsx": "typescript", ".vue": "vue",
    ".css": "css", ".scss": "scss", ".sass": "sass", ".less": "less", ".go": "go", ".rb": "ruby", ".rs": "rust", ".java": "java", ".kt": "kotlin", ".kts": "kotlin",
    ".php": "php", ".sql": "sql", ".prisma": "prisma", ".tf": "terraform",
}
JS_ORDER = [".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", ".vue", ".css", ".scss", ".sass", ".less"]
JS_INDEX = ["index.js", "index.ts", "index.jsx", "index.tsx", "index.vue"]
CSS_ORDER = [".css", ".scss", ".sass", ".less", ".styl"]
COMPOSE = ["docker-compose.yml", "docker-compose.yaml", "compose.yml", "compose.yaml", "docker-compose.override.yml", "docker-compose.override.yaml", "docker-compose.prod.yml", "docker-compose.prod.yaml", "docker-compose.dev.yml", "docker-compose.dev.yaml"]

#: language: ordered (type, how, names); how: stem, part (of the lower-case path), app (stem of a script with elements below app), stem_has, stem_end, stem_tail (.name)
TYPES = {
    "python": [("config", "stem", ["config", "settings", "constants", "env", "configuration", "conf"])],
    "javascript": [
        ("config", "stem", ["config", "settings", "constants", "env", "configuration", "conf", "vite.config", "webpack.config", "babel.config", "jest.config", "vitest.config", "tailwind.config", "next.config", "nuxt.config", "svelte.config", "astro.config", "rollup.config", "esbuild.config"]),
        ("config", "stem_tail", ["config", "settings", "constants", "env", "configuration", "conf"]),
        ("component", "suffix", [".vue"]),
        ("route", "part", ["pages", "routes", "views", "screens"]),
        ("route", "app", ["page", "layout", "loading", "error", "not-found", "template", "route"]),
        ("store", "part", ["store", "stores", "state", "redux", "slices", "atoms", "contexts", "context"]),
        ("store", "stem_has", ["store", "slice", "reducer", "context", "atom", "provider", "actions", "mutations"]),
        ("store", "text", [r"createContext\s*[(<]", r"createSlice\s*\(|createStore\s*\(|atom\s*\(|writable\s*\(|readable\s*\(|create\s*\(\s*\((?:set|get)\)"]),
        ("hook", "text", [r"export\s+(?:default\s+)?(?:const|function)\s+use[A-Z]"]),
        ("component", "suffix", [".jsx", ".tsx"]),
        ("component", "text", [r"(?m)return\s*\(?[\s\n]*<[A-Za-z/]", r"(?<!\w)<[A-Z][A-Za-z]+[\s/>]"]),
    ],
    "go": [
        ("config", "part", ["config", "cfg", "configuration", "settings", "conf"]),
        ("route", "part", ["handlers", "controllers", "routes", "api", "endpoints", "http", "server"]),
        ("store", "part", ["models", "store", "storage", "repository", "repos", "db", "database", "data", "dao"]),
    ],
    "ruby": [
        ("config", "stem", ["config", "routes", "application", "environment", "database", "gemfile", "rakefile"]),
        ("store", "part", ["models"]), ("route", "part", ["controllers"]), ("component", "part", ["views", "templates"]),
        ("module", "part", ["services", "jobs", "mailers", "workers", "interactors", "operations"]), ("config", "part", ["config"]),
    ],
    "rust": [
        ("config", "stem", ["config", "settings", "configuration", "constants", "env"]), ("config", "part", ["config", "settings", "configuration", "constants", "env"]),
        ("route", "part", ["routes", "handlers", "controllers", "endpoints", "api"]), ("store", "part", ["models", "db", "database", "storage", "repository", "repos", "store"]),
    ],
    "java": [
        ("config", "stem_has", ["config", "configuration", "application", "properties", "bootstrap", "settings"]), ("config", "part", ["config", "configuration", "application", "properties", "bootstrap", "settings"]),
        ("module", "part", ["test"]), ("module", "stem_end", ["test", "tests", "spec"]),
        ("route", "stem_end", ["controller", "resource", "endpoint", "rest", "api", "servlet"]), ("route", "part", ["controllers", "controller"]),
        ("store", "stem_end", ["service", "repository", "dao", "mapper", "store", "repo", "serviceimpl", "repositoryimpl"]), ("store", "part", ["repository", "repositories", "service"]),
    ],
    "php": [
        ("config", "part", ["config", "configuration"]), ("config", "stem", ["config", "bootstrap", "app", "routes", "kernel", "middleware"]),
        ("route", "part", ["controllers", "http", "routes", "api", "endpoints"]), ("route", "stem_end", ["controller"]),
        ("store", "part", ["models", "entities", "repositories", "services"]), ("store", "stem_end", ["model", "entity", "repository", "service", "provider"]),
    ],
    "terraform": [
        ("config", "stem", ["variables", "vars", "versions", "providers", "terraform", "backend", "locals", "settings", "outputs", "output"]),
        ("module", "part", ["modules", "module"]), ("service", "text", [r'(?m)^(?:resource|data)\s+"']),
    ],
    "css": [("style", "any", [])],
}

JS_REFS = [r"(?m)(?:^|;|\})\s*(?:import|export)\s+(?:[^'\"\n]*?\s+from\s+)?['\"]([^'\"]+)['\"]", r"require\s*\(\s*['\"]([^'\"]+)['\"]\s*\)", r"(?<!\w)import\s*\(\s*['\"]([^'\"]+)['\"]\s*\)"]
VUE_SCRIPT = r"(?si)<script(?:\s[^>]*)?>(.+?)</script>"
CSS_REFS = [r"(?i)@import\s+(?:url\s*\(\s*)?['\"]([^'\"]+)['\"]", r"(?i)@(?:use|forward)\s+['\"]([^'\"]+)['\"]"]
GO_SINGLE, GO_BLOCK, GO_LINE = r"(?m)^import\s+(?:\w+\s+)?[\"`]([^\"`\s]+)[\"`]", r"(?s)import\s*\(([^)]+)\)", r"(?:\w+\s+)?[\"`]([^\"`\s]+)[\"`]"
RUBY_REFS = [r"(?m)(?:^|;)\s*require(?:_relative)?\s+['\"]([^'\"]+)['\"]", r"(?m)autoload\s+:\w+\s*,\s*['\"]([^'\"]+)['\"]"]
RUST_MOD, RUST_CRATE, RUST_EXTERNAL = r"(?m)^(?:pub\s+)?mod\s+(\w+)\s*;", r"(?m)^use\s+((?:crate|super|self)(?:::\w+)+)", r"(?m)^use\s+(\w+)::"
RUST_STD = ["std", "core", "alloc", "proc_macro", "test", "crate", "super", "self"]
JVM_PACKAGE = {"java": r"(?m)^package\s+([\w.]+)\s*;", "kotlin": r"(?m)^package\s+([\w.]+)"}
JVM_REFS = {"java": r"(?m)^import\s+(?:static\s+)?([\w.]+)\s*;", "kotlin": r"(?m)^import\s+([\w.]+)"}
PHP_FILES, PHP_USE = r"(?i)(?:require|include)(?:_once)?\s+['\"]([^'\"]+)['\"]", r"(?m)^use\s+([\w\\]+)(?:\s+as\s+\w+)?\s*;"
SQL_TABLE, SQL_REFERENCE = r"(?i)CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?[`\"\[]?(\w+)[`\"\]]?", r"(?i)(?:FOREIGN\s+KEY\s*\([^)]+\)\s+)?REFERENCES\s+[`\"\[]?(\w+)[`\"\]]?"
PRISMA_MODEL, PRISMA_FIELD = r"(?s)\bmodel\s+(\w+)\s*\{([^}]+)\}", r"(?m)^\s+(\w+)\s+(\w+)"
PRISMA_SCALARS = ["String", "Int", "Float", "Boolean", "DateTime", "Json", "Bytes", "Decimal", "BigInt", "Unsupported"]
DOCKER_FROM = r"(?mi)^FROM\s+(?:--platform=\S+\s+)?(\S+?)(?:\s+AS\s+(\w+))?$"
GITLAB_RESERVED = ["stages", "variables", "include", "default", "workflow", "image", "services", "before_script", "after_script", "cache"]
ROUTES = [r"(?mi)@\w+\.(?:get|post|put|delete|patch|options|head)\s*\(\s*['\"]([^'\"]+)['\"]", r"(?m)@\w+\.route\s*\(\s*['\"]([^'\"]+)['\"]", r"(?m)(?:re_)?path\s*\(\s*r?['\"]([^'\"]+)['\"]"]
ROUTER_PREFIX, INCLUDED_PREFIX = r"(?m)APIRouter\s*\([^)]*prefix\s*=\s*['\"]([^'\"]+)['\"]", r"(?ms)include_router\s*\(\s*(\w+)\.router.*?prefix\s*=\s*['\"]([^'\"]+)['\"]"
CALLS = [r"(?m)fetch\s*\(\s*[`'\"](\S+?)[`'\"]", r"(?mi)\b\w+\s*\.\s*(?:get|post|put|delete|patch)\s*\(\s*[`'\"]([^`'\"]+)[`'\"]"]
NOT_API = (".js", ".css", ".png", ".svg", ".ico")

_JVM_KOTLIN = r"(?m)^(?:\s*)(?:(?:public|private|protected|internal|open|abstract|sealed|data|enum|annotation|inner|value)\s+)*(?:class|interface|object)\s+(\w+)"
#: language: (kind, pattern) in match order; the first symbol of a name in a file wins.
SYMBOLS = {
    "javascript": [
        ("function", r"(?m)^export\s+(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)"), ("class", r"(?m)^export\s+(?:default\s+)?(?:abstract\s+)?class\s+(\w+)"),
        ("enum", r"(?m)^export\s+(?:const\s+)?enum\s+(\w+)"), ("type", r"(?m)^export\s+(?:type|interface)\s+(\w+)"), ("const", r"(?m)^export\s+(?:const|let|var)\s+(\w+)"),
        ("names", r"(?m)^export\s+(?:const|let|var)\s*\{([^}]+)\}"), ("names", r"(?m)^export\s*\{([^}]+)\}"),
    ],
    "go": [("function", r"(?m)^func\s+(?:\([^)]+\)\s+)?(\w+)\s*[\[(]"), ("struct", r"(?m)^type\s+(\w+)\s+struct\b"), ("interface", r"(?m)^type\s+(\w+)\s+interface\b")],
    "java": [
        ("class", r"(?m)(?:^|\n)\s*(?:public\s+|private\s+|protected\s+)?(?:abstract\s+|final\s+|sealed\s+)?(?:class|interface|enum|record|@interface)\s+(\w+)"),
        ("function", r"(?m)(?:public|private|protected)\s+(?:(?:static|final|abstract|synchronized|native|default)\s+)*(?:[\w<>\[\]]+\s+)+(\w+)\s*\([^)]*\)\s*(?:throws\s+[\w,\s]+)?\s*[{;]"),
    ],
    "kotlin": [("class", _JVM_KOTLIN), ("function", r"(?m)^(?:\s*)(?:(?:public|private|protected|internal|override|suspend|inline|open|abstract|operator|infix|tailrec|external|actual|expect)\s+)*fun\s+(?:<[^>]+>\s+)?(\w+)\s*[\(<]")],
    "rust": [
        ("function", r"(?m)^(?:pub(?:\s*\([^)]+\))?\s+)?(?:async\s+)?(?:unsafe\s+)?fn\s+(\w+)"), ("struct", r"(?m)^(?:pub(?:\s*\([^)]+\))?\s+)?struct\s+(\w+)"),
        ("enum", r"(?m)^(?:pub(?:\s*\([^)]+\))?\s+)?enum\s+(\w+)"), ("trait", r"(?m)^(?:pub(?:\s*\([^)]+\))?\s+)?trait\s+(\w+)"),
    ],
    "php": [("class", r"(?m)^(?:abstract\s+|final\s+)?class\s+(\w+)"), ("interface", r"(?m)^interface\s+(\w+)"), ("function", r"(?m)^function\s+(\w+)\s*\(")],
    "ruby": [("class", r"(?m)^class\s+([A-Z]\w*)"), ("module", r"(?m)^module\s+([A-Z]\w*)"), ("function", r"(?m)^\s*def\s+(?:self\.)?(\w+[?!]?)")],
    "terraform": [
        ("resource", r'(?m)^resource\s+"([^"]+)"\s+"([^"]+)"'), ("data", r'(?m)^data\s+"([^"]+)"\s+"([^"]+)"'), ("module", r'(?m)^module\s+"([^"]+)"'),
        ("variable", r'(?m)^variable\s+"([^"]+)"'), ("output", r'(?m)^output\s+"([^"]+)"'), ("provider", r'(?m)^provider\s+"([^"]+)"'),
    ],
}
LISTED = r"[\s.]*(?:\w+\s+as\s+)?(\w+)(?=\s|$)"  #: one item of an export list: name, or name as alias
NOISE = {"java": ["if", "for", "while", "return", "new", "throw", "catch", "switch", "case"]}
SAME = {"typescript": "javascript", "vue": "javascript", "scss": "css", "sass": "css", "less": "css", "kotlin": "java"}

#: Terraform: what defines a name and what refers to one, per directory.
TF_DEFINES = {"resource": r'(?m)^resource\s+"([^"]+)"\s+"([^"]+)"', "data": r'(?m)^data\s+"([^"]+)"\s+"([^"]+)"', "module": r'(?m)^module\s+"([^"]+)"', "var": r'(?m)^variable\s+"([^"]+)"', "output": r'(?m)^output\s+"([^"]+)"'}
TF_REFERS = {"resource": r"\b(?!(?:var|local|data|module)\.)([a-z][a-z0-9]*(?:_[a-z0-9]+)+)\.([a-zA-Z0-9_]+)\b", "data": r"\bdata\.([a-z][a-z0-9_]*)\.([a-zA-Z0-9_]+)\b", "module": r"\bmodule\.([a-zA-Z0-9_]+)\b", "var": r"\bvar\.([a-zA-Z0-9_]+)\b", "local": r"\blocal\.([a-zA-Z0-9_]+)\b"}
TF_LOCALS, TF_LOCAL_KEY, TF_SOURCE = r"(?ms)^locals\s*\{(.*?)^\}", r"(?m)^\s+(\w+)\s*=", r'(?ms)^module\s+"([^"]+)"\s*\{.*?\bsource\s*=\s*"([^"]+)"'
TF_PROVIDER, TF_REQUIRED = r'(?m)^provider\s+"([^"]+)"', r"(?s)required_providers\s*\{((?:[^{}]|\{[^{}]*\})*)\}"
TF_ENTRIES = ["main.tf", "variables.tf", "outputs.tf"]
