"""Declared schemas of the entities."""

from __future__ import annotations

LITERAL_RECORD = "record_id string, source_id string, start_seconds double, end_seconds double, clean_literal string, raw_text string, certainty string, uncertainty string, route_agreement_min double, engine string, evidence_ids array<string>"
EVIDENCE = "evidence_id string, source_id string, kind string, literal_text string, uncertainty string, locator struct<start_seconds:double,end_seconds:double,window_id:string,track:string,page_id:string,time_ranges:array<struct<start:double,end:double>>,video:string>, confidence struct<route:string,quality:string,agreement:double>"
UNIT = "unit_id string, topic_path array<string>, claim string, conditions array<string>, exceptions array<string>, examples array<string>, certainty string, evidence_ids array<string>, source_relation string"
DISPOSITION = "evidence_id string, status string, reason string, note string"
RELATION = "relation_id string, slide_source_id string, slide_evidence_ids array<string>, candidate_audio_records array<struct<record_id:string,lexical_score:double>>, relation string, decision_route string"
OCR_PAGE = "file string, items array<struct<text:string,confidence:double,x:double,y:double,width:double,height:double>>, error string"
WHISPER = "source_id string, transcription array<struct<timestamps:struct<from:string,to:string>,offsets:struct<from:bigint,to:bigint>,text:string>>"
PROGRESS = "ts double, event string, kind string, stage string, message string, status string, counters map<string,string>"
RESOURCE = "free_mb double, total_mb double, load1 double, cores int, swap_used_mb double, ts double"
FRAME = "video string, t double, phash bigint, gray64 array<float>, lap double"

PACKAGE_TABLES = ("evidence", "literal_records", "units", "dispositions", "relations", "postings")
