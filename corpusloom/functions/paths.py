"""Column expressions on relative paths with forward slashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Language by lower-cased extension.
LANGUAGES = {
    "rs": "Rust", "ts": "TypeScript", "tsx": "TypeScript", "js": "JavaScript", "jsx": "JavaScript", "mjs": "JavaScript", "cjs": "JavaScript", "ets": "ArkTS",
    "cpp": "C++", "cc": "C++", "cxx": "C++", "hpp": "C++", "hh": "C++", "hxx": "C++", "c": "C/C++", "h": "C/C++", "py": "Python", "go": "Go", "java": "Java",
    "kt": "Kotlin", "kts": "Kotlin", "swift": "Swift", "dart": "Dart", "cs": "C#", "rb": "Ruby", "php": "PHP", "vue": "Vue", "svelte": "Svelte",
}
#: Names of configuration files, names and paths of entry points, further text extensions.
CONFIG_NAMES = [
    "Cargo.toml", "package.json", "pubspec.yaml", "oh-package.json5", "CMakeLists.txt", "build-profile.json5", "hvigorfile.ts", "module.json5",
    "tsconfig.json", "vite.config.ts", "next.config.js", "pyproject.toml", "requirements.txt", "go.mod", "pom.xml", "build.gradle",
    "settings.gradle",
]
ENTRY_NAMES = [
    "main.rs", "lib.rs", "index.ts", "index.tsx", "main.ts", "main.js", "App.ets", "EntryAbility.ets", "Index.ets", "CMakeLists.txt", "module.json5",
    "hvigorfile.ts",
]
ENTRY_PATHS = [
    "entry/src/main/ets/entryability/EntryAbility.ets", "entry/src/main/ets/pages/Index.ets", "entry/src/main/module.json5", "oh-package.json5",
    "build-profile.json5",
]
TEXT_EXTENSIONS = [
    "md", "txt", "toml", "json", "json5", "yaml", "yml",
]
#: Kinds of configuration and entry point by name.
CONFIG_KINDS = {
    "Cargo.toml": "Cargo", "package.json": "NodePackage", "pubspec.yaml": "Flutter", "oh-package.json5": "OhPackage", "CMakeLists.txt": "CMake", "build-profile.json5": "HarmonyBuild",
    "hvigorfile.ts": "Hvigor", "module.json5": "HarmonyModule", "tsconfig.json": "TypeScript", "pyproject.toml": "Python", "requirements.txt": "Python", "go.mod": "Go",
}


def normal(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent(path: Column) -> Column:
    """The folder, empty at the top."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def extension(path: Column) -> Column:
    """Behind the last dot of the name, null without one; a leading dot is none."""
    found = F.regexp_extract(name(path), r"^.+\.([^.]*)$", 1)
    return F.when(name(path).rlike(r"^.+\.[^.]*$"), found)


def stem(path: Column) -> Column:
    """The name without its last extension."""
    return F.regexp_replace(name(path), r"(?<=.)\.[^.]*$", "")


def parts(path: Column) -> Column:
    """Components, an order key that compares folder by folder."""
    return F.split(path, "/")


def module_path(path: Column) -> Column:
    return F.when(path.contains("/"), F.split(parent(path), "/")).otherwise(F.array().cast("array<string>"))


def language(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.try_element_at(table, F.lower(extension(path)))


def is_source(path: Column) -> Column:
    return F.coalesce(F.lower(extension(path)).isin(list(LANGUAGES)), F.lit(False))


def is_config(path: Column) -> Column:
    return name(path).isin(CONFIG_NAMES)


def is_entry(path: Column) -> Column:
    return name(path).isin(ENTRY_NAMES) | path.isin(ENTRY_PATHS)


def is_text(path: Column) -> Column:
    return is_source(path) | is_config(path) | F.coalesce(extension(path).isin(TEXT_EXTENSIONS), F.lit(False))


def matches_hints(path: Column, hints: Column) -> Column:
    """Whether the lower-cased path holds one of the hints."""
    return F.exists(hints, lambda h: F.lower(path).contains(F.lower(h)))


def same_path(a: Column, b: Column) -> Column:
    """Equal, or one ends in the other from a folder on."""
    return (a == b) | a.endswith(F.concat(F.lit("/"), b)) | b.endswith(F.concat(F.lit("/"), a))


def folded(path: Column) -> Column:
    """``.`` and ``..`` taken out; ``..`` at the top is dropped."""
    step = F.when
    return F.array_join(
        F.aggregate(
            F.split(path, "/"), F.array().cast("array<string>"),
            lambda a, c: step((c == "") | (c == "."), a).when(c == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(c))),
        ), "/",
    )
