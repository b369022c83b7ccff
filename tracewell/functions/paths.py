"""Paths of projects, sessions and files."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def encode_path(path: Column) -> Column:
    """A folder's name in the project list: separators become dashes."""
    coded = F.translate(path, "/\\", "--")
    return F.when(coded.startswith("-"), coded).otherwise(F.concat(F.lit("-"), coded))


def decode_path(name: Column) -> Column:
    """The path of an encoded name; dashes in the original are lost. Drive letters come back as such."""
    rest = F.regexp_replace(name, "^-", "")
    drive = F.regexp_extract(rest, r"^([A-Za-z])(?::|-)-(.*)$", 1)
    windows = F.concat(F.upper(drive), F.lit(":/"), F.translate(F.regexp_extract(rest, r"^([A-Za-z])(?::|-)-(.*)$", 2), "-", "/"))
    return F.when(F.length(drive) > 0, windows).otherwise(F.concat(F.lit("/"), F.translate(rest, "-", "/")))


def basename(path: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(path, r"[/\\]+$", ""), r"([^/\\]*)$", 1)


def dirname(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)[/\\][^/\\]*$", 1)


def is_absolute(path: Column) -> Column:
    return path.startswith("/") | path.startswith("~") | path.rlike(r"^[A-Za-z]:[/\\]") | path.startswith("\\\\")


def ancestors(path: Column, root: Column | None = None) -> Column:
    """All folders above a path, longest last; with a root, those at or below it only."""
    parts = F.split(path, "/")
    every = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    every = F.filter(every, lambda p: (p != "") & (p != path))
    return every if root is None else F.filter(every, lambda p: (p == root) | F.startswith(p, F.concat(root, F.lit("/"))))


def join_path(base: Column, relative: Column) -> Column:
    """base/relative with . and .. worked out, by one pass over the segments."""
    parts = F.filter(F.split(F.concat_ws("/", base, relative), "/"), lambda p: (p != "") & (p != "."))
    step = lambda out, p: F.when(p == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.concat(out, F.array(p)))
    done = F.aggregate(parts, F.expr("cast(array() as array<string>)"), step)
    return F.when(relative.startswith("/"), relative).otherwise(F.concat(F.when(base.startswith("/"), "/").otherwise(""), F.array_join(done, "/")))


def composite_project_id(folder: Column, cwd: Column) -> Column:
    """Id of the part of a folder's sessions that ran in cwd."""
    return F.concat(folder, F.lit("::"), F.substr(F.sha2(cwd, 256), F.lit(1), F.lit(8)))


def repository_id(identity: Column) -> Column:
    return F.substr(F.sha2(F.lower(F.trim(identity)), 256), F.lit(1), F.lit(12))


def mount_path(path: Column) -> Column:
    """A Windows path of a folder that a Linux subsystem mounts: /mnt/c/x is C:/x."""
    drive = F.regexp_extract(path, r"^/mnt/([A-Za-z])(/.*)?$", 1)
    return F.when(F.length(drive) > 0, F.concat(F.upper(drive), F.lit(":"), F.regexp_extract(path, r"^/mnt/[A-Za-z](/.*)?$", 1))).otherwise(path)


def drive_upper(path: Column) -> Column:
    """The path with its drive letter, if it has one, in upper case."""
    return F.when(path.rlike(r"^[a-z]:[/\\]"), F.concat(F.upper(F.substring(path, 1, 1)), F.substr(path, F.lit(2)))).otherwise(path)


def project_name(encoded: Column, cwd: Column | None = None) -> Column:
    """The last segment of the folder that sessions ran in, else of what the encoded name decodes to, else that name."""
    last = lambda c: F.nullif(F.regexp_extract(c, r"([^/\\]+)[/\\]*$", 1), F.lit(""))
    return F.coalesce(*([last(cwd)] if cwd is not None else []), last(decode_path(encoded)), encoded)


def shorten_path(path: Column, root: Column | None = None, most: int = 40) -> Column:
    """A path as it is shown: relative to root, ~ for a home folder, and beyond `most` characters its first segment and its last two round an ellipsis."""
    p = path
    if root is not None:
        base = F.regexp_replace(root, r"[/\\]$", "")
        inside = p.startswith(F.concat(base, F.lit("/"))) | p.startswith(F.concat(base, F.lit("\\")))
        p = F.when(F.coalesce(inside, F.lit(False)), F.substr(p, F.length(base) + 2)).otherwise(p)
    for home in (r"^/Users/[^/]+", r"^/home/[^/]+", r"^[A-Z]:\\Users\\[^\\]+"):
        p = F.regexp_replace(p, home, "~")
    sep = F.when(p.contains("\\"), F.lit("\\")).otherwise(F.lit("/"))
    parts = F.when(p.contains("\\"), F.split(p, r"\\", -1)).otherwise(F.split(p, "/", -1))
    first = F.when(F.get(parts, F.lit(0)).isin("", "~"), 1).otherwise(0)
    head = F.when(first == 1, F.concat_ws("", F.get(parts, F.lit(0)), sep, F.get(parts, F.lit(1)))).otherwise(F.get(parts, F.lit(0)))
    short = F.concat(head, sep, F.lit("…"), sep, F.try_element_at(parts, F.lit(-2)), sep, F.try_element_at(parts, F.lit(-1)))
    return F.when((F.length(p) > most) & (F.size(parts) - first > 3), short).otherwise(p)


def resolve_mention(base: Column, mention: Column) -> Column:
    """What a mentioned path names: absolute and ~ paths as they are (an @ before them is dropped), others below base, each leading ../ one folder up but never above the first."""
    bare = F.regexp_replace(mention, "^@", "")
    absolute = mention.rlike(r"^(/|\\|[A-Za-z]:[/\\])")
    rest = F.regexp_replace(bare, r"^\./", "")
    ups = F.length(F.regexp_extract(rest, r"^((?:\.\./)*)", 1)) / 3
    parts = F.filter(F.split(base, "/"), lambda x: x != "")
    kept = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - ups.cast("int"), F.least(F.size(parts), F.lit(1))))
    folder = F.concat(F.when(base.startswith("/"), "/").otherwise(""), F.array_join(kept, "/"))
    below = F.regexp_replace(rest, r"^(?:\.\./)*", "")
    joined = F.when(below == "", folder).otherwise(F.concat(folder, F.lit("/"), below))
    return F.when(absolute, mention).when(bare.rlike(r"^~($|[/\\])"), bare).otherwise(joined)


# Kinds of files by extension.
LANGUAGES = {
    "ts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "jsx", "mjs": "javascript", "cjs": "javascript",
    "py": "python", "pyw": "python", "pyx": "python",
    "html": "html", "htm": "html", "css": "css", "scss": "scss", "sass": "sass", "less": "less",
    "json": "json", "jsonl": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "xml": "xml",
    "sh": "bash", "bash": "bash", "zsh": "zsh", "fish": "fish",
    "rs": "rust", "go": "go", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "hpp": "hpp", "java": "java", "kt": "kotlin", "swift": "swift",
    "env": "env", "gitignore": "gitignore", "dockerignore": "dockerignore", "md": "markdown", "mdx": "mdx",
    "sql": "sql", "graphql": "graphql", "gql": "graphql", "vue": "vue", "svelte": "svelte", "rb": "ruby", "php": "php", "lua": "lua", "r": "r",
}


def language_of(path: Column) -> Column:
    """The kind of a file by its name, else by its extension in any case of letters; text if unknown."""
    name = basename(path)
    known = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    kind = F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))
    named = F.when(name == "Dockerfile", "dockerfile").when(name == "Makefile", "makefile").when(name.startswith(".env"), "env")
    return named.otherwise(F.coalesce(F.try_element_at(known, kind), F.lit("text")))
