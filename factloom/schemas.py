"""Declared schemas of fact documents, deltas, logs and dumps; nothing is inferred."""

from __future__ import annotations

WITNESS = "struct<kind:string,file:string,line:bigint,col:bigint,tool:string,output_sha256:string>"

ITEM = (
    "struct<id:string,kind:string,name:string,file:string,"
    "span:struct<line:bigint,col:bigint,end_line:bigint,end_col:bigint>,crate:string,module:string,parent:string,"
    "visibility:string,reexported:boolean,"
    "flags:struct<entry:boolean,unsafe:boolean,drop:boolean,generated:boolean,cfg:string>,scope:string>"
)
LINK = (
    "struct<from:string,to:struct<item:string,port:string,external:string,table:string>,member:string,kind:string,"
    f"confidence:string,witness:{WITNESS},"
    "flags:struct<origin:string,access:string,compile_time:boolean,unsafe:boolean>,reason:string>"
)
PORT = f"struct<id:string,kind:string,name:string,side:string,section:string,external:string,witness:{WITNESS}>"
EXTERNAL = f"struct<id:string,name:string,kind:string,touched:array<string>,witness:{WITNESS}>"
# framework is a string or an object; it is read as its JSON text.
ENTRY = f"struct<item:string,kind:string,framework:string,confidence:string,witness:{WITNESS}>"
TABLE = f"struct<name:string,witness:{WITNESS},queue:struct<inserters:array<string>,dequeuers:array<string>>>"
COMMIT = (
    "struct<hash:string,author:string,summary:string,trailers:array<struct<key:string,value:string>>,"
    "files:array<string>,element:string>"
)
CRATE = "struct<name:string,status:struct<kind:string,reason:string>,targets:array<string>>"

ARRAYS = {
    "crates": CRATE, "items": ITEM, "links": LINK, "ports": PORT, "externals": EXTERNAL, "entries": ENTRY,
    "tables": TABLE, "commits": COMMIT,
}

FACTS = (
    "schema_version int,repo struct<name:string,commit:string,unit:struct<id:string,main_target:string>>,"
    "analyzer struct<name:string,version:string,target:string,target_pinned:boolean,"
    "degraded:array<struct<crate:string,reason:string>>>,"
    + ",".join(f"{name} array<{kind}>" for name, kind in ARRAYS.items())
)

FILE_FACTS = "path string,file_hash string," + ",".join(
    f"{name} array<{ARRAYS[name]}>" for name in ("items", "links", "ports", "externals", "entries", "tables")
) + ",degraded string,notes string"

# Read back as flat tables; one row per element, keyed by (repo, tree_key).
FLAT = {
    "items": {
        "id": "id", "kind": "kind", "name": "name", "file": "file", "line": "span.line", "col": "span.col",
        "end_line": "span.end_line", "end_col": "span.end_col", "crate": "crate", "module": "module",
        "parent": "parent", "visibility": "visibility", "reexported": "reexported", "entry": "flags.entry",
        "cfg": "flags.cfg", "scope": "scope",
    },
    "links": {
        "from": "from", "member": "member", "kind": "kind", "confidence": "confidence", "file": "witness.file",
        "line": "witness.line", "tool": "witness.tool", "reason": "reason", "access": "flags.access",
    },
    "ports": {
        "id": "id", "kind": "kind", "name": "name", "side": "side", "section": "section", "external": "external",
        "file": "witness.file", "line": "witness.line",
    },
    "externals": {
        "id": "id", "name": "name", "kind": "kind", "touched": "touched", "file": "witness.file", "line": "witness.line",
    },
    "entries": {
        "item": "item", "kind": "kind", "framework": "framework", "confidence": "confidence", "file": "witness.file",
        "line": "witness.line",
    },
    "tables": {
        "name": "name", "file": "witness.file", "line": "witness.line", "inserters": "queue.inserters",
        "dequeuers": "queue.dequeuers",
    },
    "commits": {
        "hash": "hash", "author": "author", "summary": "summary", "trailers": "trailers", "files": "files",
        "element": "element",
    },
    "crates": {"name": "name", "status": "status.kind", "reason": "status.reason", "targets": "targets"},
}
BOOLEANS = ["reexported", "entry"]

QUESTIONS = "array<struct<text:string,options:array<string>>>"
THREAD = (
    "at string,role string,author_element string,kind string,text string,tool string,ok boolean,summary string,"
    f"questions {QUESTIONS},answers array<string>,what string,lines bigint,element string,changed boolean,driver string"
)
RECORD = (
    "session string,seq bigint,at timestamp,kind string,group string,command string,exit_code int,output string,"
    "element string,verdict string,path string,reason string,agent_reason string,what string,by string,summary string,"
    f"witnesses array<{WITNESS}>"
)
TOOL_STATE = (
    "session string,element string,expected array<struct<path:string,sha256:string>>,read map<string,string>,"
    "writes array<struct<path:string,sha256:string,at:timestamp>>"
)
PULL = (
    "number bigint,html_url string,title string,state string,draft boolean,merged_at string,"
    "head struct<ref:string,sha:string>,base struct<ref:string,sha:string>"
)
CHECK_RUNS = "check_runs array<struct<name:string,status:string,conclusion:string,html_url:string>>"
STATUSES = "statuses array<struct<context:string,state:string,target_url:string>>"
REQUESTED = "users array<struct<login:string>>,teams array<struct<slug:string>>"
REVIEW = "user struct<login:string>,state string"
PLAN_ELEMENT = "session string,pos bigint,label string,intention string,site string,files array<string>,depends_on array<string>"
SIZES = (
    "repo string,commit string,crates bigint,files bigint,lines bigint,decls bigint,decls_by_kind map<string,bigint>,"
    "items bigint,links bigint"
)
