"""Schema of an enrichment result, as it comes back from a service as JSON."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_S = "struct<start:int,end:int>"
_M = f"mentions:array<{_S}>"
ENTITIES = {
    "segments": f"id:string,kind:string,type:string,category:string,span:{_S},parent:string,children:array<string>,level:int,type_name:{_S},code:{_S},title:{_S}",
    "crossreferences": f"start:string,end:string,span:{_S}",
    "locations": f"id:string,name:{_S},type:string,{_M},parent:string,children:array<string>",
    "persons": f"id:string,name:{_S},type:string,role:string,{_M},parent:string,children:array<string>,residence:string",
    "emails": f"address:string,person:string,{_M}",
    "websites": f"url:string,person:string,{_M}",
    "phone_numbers": f"number:string,person:string,{_M}",
    "id_numbers": f"number:string,person:string,{_M}",
    "terms": f"id:string,name:{_S},meaning:{_S},{_M}",
    "external_documents": f"id:string,name:{_S},type:string,reception:string,{_M},pinpoints:array<{_S}>,jurisdiction:string",
    "quotes": f"span:{_S},amending:boolean,source_segment:string,source_document:string,source_person:string",
    "dates": f"value:string,type:string,{_M},person:string",
}
SCHEMA = "struct<" + ",".join(
    ["text:string", "type:string", "jurisdiction:string", f"title:{_S}", f"subtitle:{_S}", *(f"{k}:array<struct<{v}>>" for k, v in ENTITIES.items()), f"headings:array<{_S}>", f"junk:array<{_S}>"]
) + ">"


def parse(json: Column) -> Column:
    return F.from_json(json, SCHEMA)
