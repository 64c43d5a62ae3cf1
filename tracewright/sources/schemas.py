"""Target schemas of the data model."""

TRACE = (
    "trace_id long, title string, body string, body_full string, source string, kind string, section string, note string, channel string, "
    "subchannel string, channel_weight double, date string, salience double, sensitive boolean, "
    "provenance struct<cue:string,gold_used:array<string>,law_pass:string,human_approved:boolean,ts:timestamp>"
)
DECISION = "decision_id long, title string, choice string, reason string, cost string, context string, outcome string, project string, date string, source string, raw string"
VECTOR = "id long, text_sha1 string, model string, embedding array<float>"
VERDICT = "draft_id long, items array<struct<key:string,pass:boolean,note:string,parsed:boolean>>, smells boolean, weakest string"
RUBRIC = "ord int, key string, title string, desc string, kind string, weight double"
CHANNEL = "ord int, name string, weight double, enabled boolean"
GROWN = "title string, body string, source string, section string, note string, channel string, date string, salience double, provenance struct<cue:string,gold_used:array<string>,law_pass:string,human_approved:boolean,ts:string>"
