"""Explicit schemas; nothing is inferred from data."""

SAMPLE = "sample_id string, path string, sha256 string, md5 string, size bigint, label int, period int, family string, group_key string"
SCORES = "sample_id bigint, grp bigint, period int, y int, scores array<double>"
SIGNATURE = "digest string, size bigint"
FUZZY_SIGNATURE = "hash_type string, value string, size bigint, name string, sha256 string"

METADATA_JSON = ("path string, file string, sha256 string, label string, y string, malware string, month string, "
                 "appeared_month string, family string, avclass string")

GRAPH = ("hash string, label int, function_edges array<array<bigint>>, "
         "acfg_list array<struct<block_number:int,block_edges:array<array<bigint>>,block_features:array<array<double>>>>, "
         "function_names array<string>")

# The nested feature record; free-form numbers stay strings so that text and numbers are both accepted.
FEATURE_JSON = (
    "label int, appeared string, histogram array<double>, byteentropy array<double>, "
    "strings struct<numstrings:double,avlength:double,printables:double,entropy:double,paths:double,urls:double,registry:double,MZ:double,printabledist:array<double>>, "
    "general struct<size:double,vsize:double,has_debug:double,exports:double,imports:double,has_relocations:double,has_resources:double,has_signature:double,has_tls:double,symbols:double>, "
    "header struct<coff:map<string,string>,optional:map<string,string>>, "
    "section struct<entry:string,sections:array<struct<name:string,size:double,entropy:double,vsize:double,props:array<string>>>>, "
    "imports map<string,array<string>>, exports array<string>, datadirectories array<struct<size:double,virtual_address:double>>")

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
