"""Explicit schemas; every table's key starts with repo_id, so one job serves a corpus of repositories."""

TREE = "repo_id string, path string, is_dir boolean, size long, mtime double, text string"
FILES = "repo_id string, path string, raw_language string, language string, size long, mtime double, loc long"
FUNCTION = "struct<name:string,line:int,calls:array<string>>"
CLASS = f"struct<name:string,line:int,bases:array<string>,interfaces:array<string>,methods:array<{FUNCTION}>>"
#: What a parser says of one file: imports are kept as written and resolved by joins.
IR = f"repo_id string, path string, language string, imports array<struct<kind:string,module:string,level:int,names:array<string>>>, classes array<{CLASS}>, functions array<{FUNCTION}>, error string"
NODES = "repo_id string, id string, kind string, name string, path string, line int, language string"
EDGES = "repo_id string, source string, target string, kind string"
DEPENDENCIES = "repo_id string, name string, version string, source string, dev boolean, ordinal int"
COMMITS = "repo_id string, sha string, author string, author_date string, subject string, is_root boolean, ordinal long, error string"
COMMIT_FILES = "repo_id string, sha string, path string, error string"
NOTES = "repo_id string, id string, text string, scope string, created string, source string"
