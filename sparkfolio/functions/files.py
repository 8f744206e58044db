"""Expressions on file paths, sizes, kinds, times and sources."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions by kind.
EXTENSIONS = {
    "excel": (".xlsx", ".xlsm", ".xltx", ".xltm", ".xls", ".xlsb"),
    "pdf": (".pdf",),
    "word": (".docx", ".docm"),
    "ppt": (".pptx", ".pptm"),
    "text": (
        ".txt", ".csv", ".tsv", ".log", ".md", ".ini", ".json", ".xml", ".html", ".htm", ".py", ".bat", ".cmd", ".ps1",
        ".sql", ".yaml", ".yml", ".cfg", ".conf", ".properties", ".rtf",
    ),
    "archive": (".zip", ".7z", ".rar"),
}
#: Extensions of files that hold no text.
BINARY = (
    ".exe", ".dll", ".bin", ".iso", ".zip", ".7z", ".rar", ".tar", ".gz", ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".tif",
    ".tiff", ".webp", ".mp3", ".wav", ".mp4", ".mov", ".avi", ".db", ".sqlite", ".doc", ".ppt", ".xls.old",
)
UNKNOWN = "?"


def kind_of_extension(extension: str) -> str:
    extension = "." + extension.lower().lstrip(".")
    return next((k for k, xs in EXTENSIONS.items() if extension in xs), UNKNOWN)


def kind(extension: Column) -> Column:
    dotted = F.concat(F.lit("."), F.regexp_replace(F.lower(extension), r"^\.+", ""))
    out = F.lit(UNKNOWN)
    for name, known in EXTENSIONS.items():
        out = F.when(dotted.isin(*known), name).otherwise(out)
    return out


def name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)[/\\]*$", 1)


def directory(path: Column) -> Column:
    return F.regexp_replace(path, r"[/\\]+[^/\\]*$", "")


def extension(path: Column) -> Column:
    """Lower-cased, with its dot; empty for none and for names that begin with their only dot."""
    return F.lower(F.regexp_extract(name(path), r"^.+(\.[^.]*)$", 1))


def path_key(path: Column, *, caseless: bool = False) -> Column:
    """Identity of a path: one kind of slash, no empty or ``.`` steps, ``..`` undone; lower case where case tells nothing apart."""
    slashed = F.regexp_replace(path, r"\\", "/")
    steps = F.split(F.lower(slashed) if caseless else slashed, "/")
    kept = F.filter(steps, lambda s: (s != "") & (s != "."))
    stack = F.aggregate(kept, F.expr("cast(array() as array<string>)"), lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, s)))
    return F.concat(F.when(slashed.startswith("/"), "/").otherwise(""), F.array_join(stack, "/"))


def is_under(path: Column, root: str) -> Column:
    root = root.replace("\\", "/").rstrip("/")
    slashed = F.regexp_replace(path, r"\\", "/")
    return (slashed == root) | slashed.startswith(root + "/")


def human_size(size: Column) -> Column:
    """In units of 1024, one decimal from KB on."""
    out = F.format_string("%d B", size.cast("long"))
    for power, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = F.when(size >= 1024**power, F.format_string(f"%.1f {unit}", size / float(1024**power))).otherwise(out)
    return out


def modified_day(mtime_ns: Column) -> Column:
    """The calendar day of a time in the session's zone."""
    return F.to_date(F.timestamp_micros(((mtime_ns - F.pmod(mtime_ns, F.lit(1000))) / 1000).cast("long")))


def source_type(path: Column, removable: Iterable[str] = ()) -> Column:
    """Where a path lies, by its spelling; ``removable`` names roots of exchangeable media. Unknown without a path."""
    low = F.lower(F.regexp_replace(path, r"\\", "/"))
    out = F.when(low.isNull() | (low == ""), "unknown").when(low.startswith("//"), "smb")
    for root in removable:
        out = out.when(is_under(low, root.lower()), "removable")
    return out.when(low.rlike("(^|/)onedrive[^/]*/"), "onedrive").otherwise("local")


def cloud_state(attributes: Column, source: Column) -> Column:
    """From attribute bits: online only if recalled on access or offline, pinned, else local."""
    bit = lambda mask: attributes.bitwiseAND(F.lit(mask)) != 0
    pinned = bit(0x80000) & ~bit(0x100000)
    state = F.when(bit(0x40000) | bit(0x400000) | bit(0x1000), "online").when(pinned, "pinned").otherwise("local")
    return F.when(source == "smb", "smb").otherwise(state)


def cloud_decision(state: Column, indexed: Column, mode: str, policy: str) -> Column:
    """read, index or skip for a file: one that lies online only is fetched, served from an index, or passed over."""
    if policy == "fetch":
        return F.lit("read")
    out = F.when(state != "online", "read")
    return out.otherwise("skip") if policy == "skip" or mode == "fast" else out.when(indexed, "index").otherwise("read")


def source_label(source: Column, cloud: Column) -> Column:
    """Where a file lies, and ``online`` or ``pinned`` behind it."""
    return F.when(cloud.isin("online", "pinned"), F.concat_ws(" ", source, cloud)).otherwise(source)


def fingerprint(parts: Iterable[Column]) -> Column:
    """One string for the versions and settings that an extraction depends on."""
    return F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def column_letter(index: int) -> str:
    """Spreadsheet letters of a column counted from 0."""
    out = ""
    index += 1
    while index:
        index, rest = divmod(index - 1, 26)
        out = chr(65 + rest) + out
    return out
