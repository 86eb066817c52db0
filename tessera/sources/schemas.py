"""Explicit schemas of the tables the engine works on."""

from __future__ import annotations

REGISTER = "`number` string, base string, digits string, title string, family string, year int, status string, replaced_by string, supersedes string, priority string, link string, flag string, provenance string, title_local string, review_due date"
DOCUMENTS = "doc string, family string, cited string, foreign_cited string, n_cited int, outdated string, any_outdated string, kind string, usability string, link string, unmatched string, category string, bid_id string, ministry string, department string, organisation string, office string, demands_mark string"
EDGES = "src string, dst string, n_src long, n_dst long, co long, confidence double, lift double, evidence string"
RULES = "`number` string, product string, category string, family string, mandatory string, scheme string, notification string, link string, base string"
BACKLOG = "n_docs int, `number` string"
DECISIONS = "id string, created_at timestamp, officer string, document string, finding_kind string, `number` string, decision string, rationale string, system_said string"
RUNS = "started string, finished string, seconds double, stages array<string>, apply boolean, changed long, results array<struct<stage:string,outcome:string,changed:long>>"
GOLDEN = "query string, expected string, source string, family string"
BLOCK = "struct<kind:string,text:string,align:string,rows:array<array<string>>>"
