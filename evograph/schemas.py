"""The tables of the engine, as DDL."""

EVENTS = ("conv bigint, event_id string, event_type string, participants array<string>, time_anchor string, state_change string, provenance string, source_note_ids array<string>, valid_until string, update_val double, event_seq bigint")
EDGES = ("conv bigint, src string, dst string, edge_type string, confidence double, reason string, t_invalid_at string, edge_seq bigint")
SESSIONS = ("conv bigint, session_id string, session_key string, summary string, date_time string, note_ids array<string>, event_ids array<string>, original_session_id string")
TOPICS = ("conv bigint, topic_id string, label string, session_ids array<string>, description string")
NOTES = ("conv bigint, note_id string, note_pos bigint, content string, keywords array<string>, links array<int>, importance_score double, retrieval_count int, timestamp string, last_accessed string, context string, evolution_history array<string>, category string, tags array<string>")

#: The file of a graph: entities as JSON, events in a map by id.
GRAPH_FILE = (
    "metadata struct<schema_version:string>, events map<string,struct<event_id:string,event_type:string,participants:array<string>,time_anchor:string,state_change:string,provenance:string,source_note_ids:array<string>,valid_until:string,update_val:double>>, "
    "edges array<struct<source_event_id:string,target_event_id:string,edge_type:string,confidence:double,reason:string,t_invalid_at:string>>, "
    "sessions array<struct<session_id:string,session_key:string,summary:string,date_time:string,note_ids:array<string>,event_ids:array<string>,original_session_id:string>>, "
    "topics array<struct<topic_id:string,label:string,session_ids:array<string>,description:string>>, hyperedges array<struct<h_id:string,edge_type:string,member_ids:array<string>,confidence:double>>"
)
#: Conversation samples: session_N keys vary, so the conversation is read as a map of raw JSON.
SAMPLES = ("qa array<struct<question:string,answer:string,evidence:array<string>,category:int,adversarial_answer:string>>, conversation map<string,string>, event_summary map<string,map<string,array<string>>>, session_summary map<string,string>")
TURNS = ("speaker string, dia_id string, text string, img_url string, blip_caption string")
#: Question records with a haystack of sessions in three parallel arrays.
HAYSTACKS = ("question_id string, question string, question_type string, question_date string, answer string, haystack_session_ids array<string>, haystack_dates array<string>, haystack_sessions array<array<struct<role:string,content:string>>>, answer_session_ids array<string>")
SUMMARY_CACHE = ("session_id string, summary string")
EXTRACTION_LOG = ("session_id string, n_events int, n_edges int, error string")
