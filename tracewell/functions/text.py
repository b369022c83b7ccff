"""Scalar functions over message text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values of the transcript format.
STDOUT, STDERR = "<local-command-stdout>", "<local-command-stderr>"
CAVEAT, REMINDER = "<local-command-caveat>", "<system-reminder>"
SYSTEM_TAGS = (STDERR, STDOUT, CAVEAT, REMINDER)
NOISE_TAGS = (CAVEAT, REMINDER)
INTERRUPTED = "[Request interrupted by user"
TEAMMATE = r'^<teammate-message\s+teammate_id="([^"]+)"'
# First segments that make a path a file reference.
KNOWN_DIRS = (
    "src apps app lib types packages components utils services hooks store renderer main preload public assets config tests test specs spec e2e docs scripts "
    "screens features pages views models controllers routes middleware api common shared core modules client server web mobile native electron node_modules"
).split()


def js_trim(c: Column) -> Column:
    """Without white space at both ends, line ends included."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def estimate_tokens(c: Column) -> Column:
    """Four characters to a token, rounded up; null and empty are 0."""
    return F.ceil(F.coalesce(F.length(c), F.lit(0)) / 4).cast("long")


def call_tokens(name: Column, input_json: Column) -> Column:
    return estimate_tokens(F.concat(name, F.coalesce(input_json, F.lit("{}"))))


def _inside(c: Column, tag: str, body: str = "(?s)(.*?)", flags: str = "(?i)") -> Column:
    """The text inside the first such tag; null without one."""
    inner = body.removeprefix("(?s)")
    s = "(?s)" if body.startswith("(?s)") else ""
    pattern = f"{flags}{s}<{tag}>{inner}</{tag}>"
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, 1))


def command_output(c: Column) -> Column:
    return F.coalesce(_inside(c, "local-command-stdout"), _inside(c, "local-command-stderr"))


def slash_name(c: Column) -> Column:
    pattern = "<command-name>/([^<]+)</command-name>"
    return F.when(c.rlike(pattern), js_trim(F.regexp_extract(c, pattern, 1)))


def slash_args(c: Column) -> Column:
    return js_trim(_inside(c, "command-args", "([^<]*)", ""))


def slash_message(c: Column) -> Column:
    return js_trim(_inside(c, "command-message", "([^<]*)", ""))


def is_command(c: Column) -> Column:
    return c.startswith("<command-name>") | c.startswith("<command-message>")


def is_command_output(c: Column) -> Column:
    return c.startswith(STDOUT) | c.startswith(STDERR)


def command_display(c: Column) -> Column:
    args = slash_args(c)
    return F.when(slash_name(c).isNotNull(), F.concat(F.lit("/"), slash_name(c), F.when(F.length(args) > 0, F.concat(F.lit(" "), args)).otherwise("")))


def sanitize(c: Column) -> Column:
    """What is shown of a text: command output and commands themselves, else the text without metadata tags."""
    plain = c
    for tag in ("local-command-caveat", "system-reminder", "task-notification", "command-name", "command-message", "command-args"):
        plain = F.regexp_replace(plain, f"(?is)<{tag}>.*?</{tag}>", "")
    plain = js_trim(F.regexp_replace(plain, r" ?Read the output file to retrieve the result: [^\s]+", ""))
    output = js_trim(command_output(c))
    return F.when(is_command_output(c) & (F.length(output) > 0), output).when(is_command(c) & command_display(c).isNotNull(), command_display(c)).otherwise(plain)


def task_notifications(c: Column) -> Column:
    """Array of (task_id, status, summary, output_file) of each notification block."""
    blocks = F.regexp_extract_all(c, F.lit("(?is)<task-notification>(.*?)</task-notification>"), F.lit(1))
    part = lambda b, tag: F.regexp_extract(b, f"(?s)<{tag}>(.*?)</{tag}>", 1)
    return F.transform(blocks, lambda b: F.struct(part(b, "task-id").alias("task_id"), part(b, "status").alias("status"), js_trim(part(b, "summary")).alias("summary"), part(b, "output-file").alias("output_file")))


def teammate_messages(c: Column) -> Column:
    """Array of (teammate_id, color, summary, content) of each teammate block."""
    whole = F.regexp_extract_all(c, F.lit(r'(?s)(<teammate-message\s+teammate_id="[^"]+"[^>]*>.*?</teammate-message>)'), F.lit(1))
    return F.transform(
        whole,
        lambda b: F.struct(
            F.regexp_extract(b, TEAMMATE, 1).alias("teammate_id"),
            F.regexp_extract(b, r'^[^>]*\scolor="([^"]*)"', 1).alias("color"),
            F.regexp_extract(b, r'^[^>]*\ssummary="([^"]*)"', 1).alias("summary"),
            js_trim(F.regexp_extract(b, r"(?s)^[^>]*>(.*)</teammate-message>$", 1)).alias("content"),
        ),
    )


def file_references(c: Column) -> Column:
    """Paths after an @ that are relative, begin with a known folder, or have a separator."""
    found = F.regexp_extract_all(c, F.lit("@([~a-zA-Z0-9._/-]+)"), F.lit(1))
    known = F.array(*map(F.lit, KNOWN_DIRS))
    relative = lambda p: p.startswith("./") | p.startswith("../") | p.startswith("~/")
    return F.filter(found, lambda p: relative(p) | F.array_contains(known, F.substring_index(p, "/", 1)) | (p.contains("/") & (F.length(p) > 2)))


def slash_commands(c: Column) -> Column:
    """Array of (name, args) of the lines that are a command."""
    lines = F.regexp_extract_all(c, F.lit(r"(?im)(/[a-z][a-z0-9-]*(?:[ \t][^\n]*)?)$"), F.lit(1))
    return F.transform(lines, lambda s: F.struct(F.regexp_extract(s, "(?i)^/([a-z][a-z0-9-]*)", 1).alias("name"), js_trim(F.regexp_extract(s, r"(?i)^/[a-z][a-z0-9-]*[ \t]?(.*)$", 1)).alias("args")))


def truncate(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def truncate_middle(c: Column, n: int) -> Column:
    left = (n - 3 + 1) // 2
    right = n - 3 - left
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, left), F.lit("..."), F.right(c, F.lit(right)))).otherwise(c)


def string_hash(c: Column) -> Column:
    """The 32-bit hash h * 31 + unit over a string's UTF-16 units, kept in a signed 32-bit range; a character beyond the first 65,536 has two units."""
    wrap = lambda x: F.pmod(x + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)

    def step(h: Column, x: Column) -> Column:
        code = F.ascii(x)
        high, low = F.shiftright(code - 0x10000, 10) + 0xD800, (code - 0x10000).bitwiseAND(0x3FF) + 0xDC00
        return F.when(code < 0x10000, wrap(h * 31 + code)).otherwise(wrap(wrap(h * 31 + high) * 31 + low))

    return F.aggregate(F.filter(F.split(c, ""), lambda x: x != ""), F.lit(0).cast("long"), step)


def hash_id(c: Column) -> Column:
    """The hash without its sign, as lower-case hexadecimal digits: ids of what enters a context."""
    return F.lower(F.hex(F.abs(string_hash(c))))


def _bound(value: Column, use) -> Column:
    """use(value), with the value worked out once: as a plain expression it would be repeated at each use, and Spark parses a JSON text anew for each field that is read."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: The fields of inputs that tool_summary() reads.
_SUMMARY_INPUT = "file_path string, description string, command string, pattern string, subagent_type string, prompt string, skill string, url string, query string, name string, path string, file string"


def tool_summary(name: Column, input_json: Column) -> Column:
    """One line about a tool call, from its name and its input, which is parsed once."""
    has = lambda c: F.when(F.length(c) > 0, c)
    quoted = lambda c, n: F.concat(F.lit('"'), truncate(c, n), F.lit('"'))
    base = lambda c: F.regexp_extract(c, r"([^/\\]*)$", 1)

    def line(given: Column) -> Column:
        get = lambda k: given[k]
        kind, desc = has(get("subagent_type")), F.coalesce(get("description"), get("prompt"))
        site = F.concat(F.parse_url(get("url"), F.lit("HOST")), F.coalesce(has(F.parse_url(get("url"), F.lit("PATH"))), F.lit("/")))
        rest = F.coalesce(*[get(k) for k in ("name", "path", "file", "query", "command")])
        return (
            F.when(name.isin("Edit", "Read", "Write"), base(has(get("file_path"))))
            .when(name == "Bash", F.coalesce(truncate(has(get("description")), 50), truncate(has(get("command")), 50)))
            .when(name.isin("Grep", "Glob"), quoted(has(get("pattern")), 30))
            .when(name == "Task", F.coalesce(F.concat(F.coalesce(F.concat(kind, F.lit(" - ")), F.lit("")), truncate(has(desc), 40)), kind))
            .when(name == "Skill", has(get("skill")))
            .when(name == "WebFetch", F.coalesce(truncate(site, 50), truncate(has(get("url")), 50)))
            .when(name == "WebSearch", quoted(has(get("query")), 40))
            .otherwise(truncate(rest, 50))
        )

    return F.coalesce(_bound(F.from_json(input_json, _SUMMARY_INPUT), line), name)


#: The fields of inputs that tool_line() reads.
_INPUT = (
    "file_path string, old_string string, new_string string, limit long, offset long, content string, command string, description string, pattern string, path string, glob string, "
    "prompt string, subagentType string, operation string, filePath string, url string, query string, todos array<string>, notebook_path string, edit_mode string, team_name string, "
    "subject string, taskId string, status string, owner string, type string, recipient string, summary string, name string, file string"
)


def tool_line(name: Column, input_json: Column) -> Column:
    """The longer line about a tool call: names of files with counts of lines, ranges, places, recipients. The input is parsed once (see _bound); tools that aren't known look at its first value too."""
    first = F.element_at(F.map_values(F.from_json(input_json, "map<string,string>")), 1)
    other = F.when(F.size(F.json_object_keys(input_json)) > 0, first)
    known = _bound(F.from_json(input_json, _INPUT), lambda parsed: _line(name, parsed))
    plain = F.when(~name.isin(*_LINE_TOOLS), truncate(other, 40))
    return F.coalesce(known, plain, name)


# The tools that have a line of their own.
_LINE_TOOLS = (
    "Edit", "Read", "Write", "Bash", "Grep", "Glob", "Task", "LSP", "WebFetch", "WebSearch", "TodoWrite", "NotebookEdit", "TeamCreate", "TaskCreate", "TaskUpdate", "TaskList", "TaskGet", "SendMessage", "TeamDelete",
)


def _line(name: Column, parsed: Column) -> Column:
    """The line of a known tool, or the field that says most of another one's input; null if there is none. The wordings are fixed values."""
    get = lambda k: parsed[k]
    some = lambda c: F.when(F.length(c) > 0, c)
    base = lambda k: F.regexp_extract(some(get(k)), r"([^/\\]*)$", 1)
    lines = lambda k: F.size(F.split(some(get(k)), "\n", -1))
    text = lambda c: c.cast("string")
    join = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    quoted = lambda k, n: join('"', truncate(some(get(k)), n), '"')
    old, new = lines("old_string"), lines("new_string")
    both = some(get("old_string")).isNotNull() & some(get("new_string")).isNotNull()
    edited = F.when(both & (old == new), join(base("file_path"), " - ", text(old), F.when(old > 1, " lines").otherwise(" line")))
    edited = F.coalesce(edited, F.when(both, join(base("file_path"), " - ", text(old), " -> ", text(new), " lines")), base("file_path"))
    start = F.coalesce(get("offset"), F.lit(1))
    read = F.coalesce(F.when(get("limit") != 0, join(base("file_path"), " - lines ", text(start), "-", text(start + get("limit") - 1))), base("file_path"))
    written = F.coalesce(join(base("file_path"), " - ", text(lines("content")), " lines"), base("file_path"))
    place = lambda *where: F.coalesce(*[join(quoted("pattern", 30), " in ", w) for w in where], quoted("pattern", 30))
    kind, told = some(get("subagentType")), F.coalesce(get("description"), get("prompt"))
    site = join(F.parse_url(get("url"), F.lit("HOST")), F.coalesce(some(F.parse_url(get("url"), F.lit("PATH"))), F.lit("/")))
    count = F.size(get("todos"))
    todos = F.when(get("todos").isNotNull(), join(text(count), F.when(count == 1, " item").otherwise(" items")))
    team = join(some(get("team_name")), F.coalesce(join(" - ", truncate(some(get("description")), 30)), F.lit("")))
    update = F.concat_ws(" ", join("#", some(get("taskId"))), some(get("status")), join("-> ", some(get("owner"))))
    note = truncate(F.coalesce(get("summary"), F.lit("")), 30)
    to = some(get("recipient"))
    sent = (
        F.when((get("type") == "shutdown_request") & to.isNotNull(), join("Shutdown ", to)).when(get("type") == "shutdown_response", "Shutdown response")
        .when(get("type") == "broadcast", join("Broadcast: ", note)).when(to.isNotNull(), join("To ", to, ": ", note)).otherwise("Send message")
    )
    by_name = {
        "Edit": edited, "Read": read, "Write": written, "Bash": F.coalesce(truncate(some(get("description")), 50), truncate(some(get("command")), 50)),
        "Grep": place(some(get("glob")), base("path")), "Glob": place(base("path")),
        "Task": F.coalesce(join(F.coalesce(join(kind, " - "), F.lit("")), truncate(some(told), 40)), kind),
        "LSP": F.coalesce(join(some(get("operation")), " - ", base("filePath")), some(get("operation"))),
        "WebFetch": F.coalesce(truncate(site, 50), truncate(some(get("url")), 50)), "WebSearch": quoted("query", 40), "TodoWrite": todos,
        "NotebookEdit": F.coalesce(join(some(get("edit_mode")), " - ", base("notebook_path")), base("notebook_path")),
        "TeamCreate": F.coalesce(team, F.lit("Create team")), "TaskCreate": F.coalesce(truncate(some(get("subject")), 50), F.lit("Create task")),
        "TaskUpdate": F.coalesce(some(update), F.lit("Update task")), "TaskList": F.lit("List tasks"),
        "TaskGet": F.coalesce(join("Get task #", some(get("taskId"))), F.lit("Get task")), "SendMessage": sent, "TeamDelete": F.lit("Delete team"),
    }
    other = truncate(F.coalesce(*[get(k) for k in ("name", "path", "file", "query", "command")]), 50)
    out = F.when(F.lit(False), name)
    for tool, line in by_name.items():
        out = out.when(name == tool, line)
    return out.otherwise(other)
