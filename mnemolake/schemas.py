"""Schemas of the stored entities as DDL text. Open fields live in one string map."""

SCOPE = ["tenant_id", "user_id"]
QUERY = [*SCOPE, "query_id"]  # ids of queries and requests are unique within a scope only
REQUEST = [*SCOPE, "request_id"]

TURN = (
    "struct<role:string,content:string,turn_index:int,timestamp:timestamp,token_count:int,dia_id:string,"
    "speaker_name:string,has_answer:boolean,img_url:string,caption:string,extra:string>"
)
SESSION = (
    f"struct<session_id:string,turns:array<{TURN}>,session_date:timestamp,session_start:timestamp,"
    "speaker_a:string,speaker_b:string,session_summary:string,session_observation:string,extra:string>"
)
INGEST_REQUEST = (
    "request_id string, tenant_id string, user_id string, raw_data_type string, event_time timestamp,"
    "agent_id string, agent_role string, adiu string, session_id string, idempotency_key string,"
    f"min_read_consistency int, metadata map<string,string>, history_sessions array<{SESSION}>"
)
RAW = (
    "raw_id string, request_id string, tenant_id string, user_id string, session_id string,"
    "raw_data_type string, pos bigint, content string, event_time timestamp, metadata map<string,string>"
)
CELL = (
    "mem_cell_id string, tenant_id string, user_id string, session_id string, group_id string,"
    "raw_data_ids array<string>, source_message_ids array<string>, text string, summary string, subject string,"
    "episode string, keywords array<string>, embedding array<float>, participants array<string>, state string,"
    "strength double, access_count int, importance_score double, timestamp timestamp, created_at timestamp,"
    "updated_at timestamp, consolidation_status string, extra map<string,string>"
)
EPISODE = (
    "episode_id string, mem_cell_id string, tenant_id string, user_id string, summary string, content string,"
    "key_entities array<string>, emotional_valence double, emotional_salience double, emotion_type string,"
    "event_time string, event_time_range string, importance_score double"
)
FACT = (
    "semantic_id string, tenant_id string, user_id string, content string, knowledge_type string,"
    "source_episode_ids array<string>, source_memcell_ids array<string>, start_time string, end_time string,"
    "duration_days int, confidence double, is_valid boolean, evidence_count int, embedding array<float>"
)
SCENE = (
    "scene_id string, tenant_id string, user_id string, member_episode_ids array<string>, member_count int,"
    "centroid array<double>, pending_semantic_digest boolean, last_updated_at timestamp"
)
RANKED = (
    "query_id string, tenant_id string, user_id string, channel string, memory_id string, score double, rank int"
)
NODE = (
    "node_id string, node_type string, tenant_id string, user_id string, label string, memory_id string,"
    "is_valid boolean"
)
EDGE = (
    "edge_id string, edge_type string, tenant_id string, user_id string, source_node_id string,"
    "target_node_id string, confidence double, strength double, source_memory_ids array<string>, is_valid boolean"
)
EVENT_LOG = ("time string, atomic_facts array<string>, fact_embeddings array<array<float>>")
FEEDBACK = (
    "event_id bigint, tenant_id string, user_id string, mem_cell_id string, memory_id string,"
    "feedback_type string, signal_value double, ts timestamp"
)
DEAD_LETTER = (
    "event_id bigint, target string, mem_cell_id string, operation string, error string, retry_count int, ts timestamp"
)
PARAMETER = (
    "category string, scope string, scope_id string, name string, params string, variants string,"
    "version int, updated_at timestamp, actor string"
)
META = (
    "meta_id string, tenant_id string, user_id string, target_memory_id string, target_memory_type string,"
    "provenance struct<source:string,proposed_by:string,created_at:timestamp,modified_at:timestamp,version:string,"
    "linked_memory_ids:array<string>,linked_entities:array<string>,keywords:array<string>>,"
    "lifecycle struct<access_count:int,reinforce_count:int,score:double,confidence:double,lifecycle:string,"
    "consolidation_status:string>, access_control struct<visibility_scope:string,shared_agent_ids:array<string>,"
    "share_status:string>"
)

# Domains of the string enums (fixed values).
MEMORY_TYPES = ("EPISODIC", "SEMANTIC", "PROFILE", "META")
MEMORY_STATES = ("ACTIVE", "WARM", "COLD", "ARCHIVED")
CONSOLIDATION_STATUS = ("pending", "nrem_processed", "rem_processed", "done")
KNOWLEDGE_TYPES = ("knowledge", "fact", "preference", "goal")
FEEDBACK_TYPES = ("positive", "negative", "correction", "deletion_request", "explicit_confirm")
ROLES = ("user", "assistant", "system")
RAW_DATA_TYPES = ("CONVERSATION", "DOCUMENT", "EVENT")
