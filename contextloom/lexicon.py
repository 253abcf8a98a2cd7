"""Word lists, names and limits. All are defaults: operators take them as parameters."""

from __future__ import annotations

# Words that carry no topic.
STOP_WORDS = (
    "a about an and are as at be been but by can could did do does else for from had has have he if in is it its may me might "
    "no nor not of on or shall she should so that the then these they this those to us use used using was we were when while "
    "will with would yet you"
).split()

# Phrases that mark a line of a conversation, in order of precedence.
POSITIVE_TRIGGERS = ["must", "should", "required", "always"]
NEGATIVE_TRIGGERS = ["cannot", "never", "avoid", "do not", "don't", "forbidden", "prohibited"]
DECISION_TRIGGERS = ["decided", "decision", "agreed", "we will", "going with", "let's use", "chosen", "confirmed", "settled on", "we are using"]
NEGATIONS = ["not", "no", "never"]
FIRST_PERSON = ["we", "i", "let's", "lets", "you"]
CLAUSE_MARKS = [",", ";", "—", "–"]
COMMENT_MARKS = ["//", "#", "--", "*"]

# Parts of a line's confidence.
CONFIDENCE = {"match": 0.4, "first_person": 0.2, "first_clause": 0.2, "further": 0.1, "short": 0.1}
SHORT_WORDS = 15
QUESTION_CONFIDENCE = 0.6
RESOLVED_OVERLAP = 0.4

# Extensions that make a word of a conversation a file mention.
MARKER_EXTENSIONS = ["rs", "go", "ts", "js", "tsx", "jsx", "py", "toml", "json", "yaml", "yml", "md", "txt"]

# What a repository scan passes over, and its size limit in bytes.
SKIPPED_FOLDERS = [".git", "target", "node_modules", "dist", "build", ".contextloom"]
SKIPPED_EXTENSIONS = ["lock"]
MAX_FILE_BYTES = 204_800
LOGGED_COMMITS = 20

# Manifests that a summary of a repository always names.
MANIFESTS = ["Cargo.toml", "package.json", "pyproject.toml", "go.mod", "Makefile", "CMakeLists.txt", "build.gradle", "pom.xml", "mix.exs"]

# Weights of a file's relevance, and of a changed file's.
RELEVANCE = {"keywords": 0.40, "symbols": 0.30, "recency": 0.20, "dependencies": 0.10}
RECENCY = [(0, 1.0), (4, 0.7), (19, 0.3)]
CHANGE = {"churn": 0.3, "symbols": 0.3, "affected": 0.2, "kind": 0.2}
VECTOR_WEIGHT = 0.30
CHUNK_WEIGHT, SYMBOL_WEIGHT = 0.6, 0.4

# Token budget shares, focus and chunk sizes.
SUMMARY_LEAST, SUMMARY_SHARE, MEMORY_SHARE, SAFETY_SHARE = 300, 0.05, 0.20, 0.05
FOCUS_HEAD, FOCUS_PADDING, FOCUS_WORTH, SUMMARY_BYTES = 10, 5, 0.8, 300
CHUNK_TOKENS, CHUNK_OVERLAP, NEAREST = 256, 32, 50
PRIMARY_SCORE = 0.4

# Kinds of symbols with their sections in a symbol graph; further kinds have none.
SYMBOL_SECTIONS = {
    "function": "functions",
    "struct": "structs",
    "class": "classes",
    "enum": "enums",
    "trait": "traits",
    "interface": "interfaces",
    "module": "modules",
    "method": "methods",
    "constant": "constants",
}

# Names of languages after the opening marks of a code block.
FENCES = {
    "rs": "rust", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "py": "python", "go": "go", "ex": "elixir", "exs": "elixir",
    "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "h": "cpp", "hpp": "cpp", "toml": "toml", "json": "json", "yaml": "yaml", "yml": "yaml", "md": "markdown",
    "scss": "scss", "css": "css", "html": "html", "sh": "bash", "bash": "bash", "sql": "sql", "xml": "xml", "java": "java", "rb": "ruby", "as": "angelscript",
}
