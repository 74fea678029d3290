"""Schemas of gold and prediction records, items, jobs and page arrivals, and the closed vocabularies."""

# The fields of records, items and pages.
GOLD = """item_id string,
strata struct<has_vtt:boolean,is_slideshow:boolean,duration_tercile:int>,
mentions array<struct<mention_id:string,surface:string,aliases:array<string>,type:string,gold_id:struct<authority:string,id:string>,nil:string,failed_queries:array<string>,kb_snapshot:struct<authority:string,retrieved:string>,hard_case:boolean,verification:struct<name:string,address:string,lat:double,lng:double,url:string>,notes:string>>,
concepts array<struct<concept_id:string,authority:string,label:string>>,
facets map<string,string>,
structured array<struct<schemaOrgType:string,slots:array<struct<name:string,value:string>>,steps:array<struct<`order`:int,text:string>>>>,
claims array<struct<claim_id:string,statement:string>>"""

PRED = """item_id string,
mentions array<struct<surface:string,type:string,grounding:struct<authority:string,externalId:string,nil:boolean,grounding_confidence:double>>>,
concepts array<struct<concept_id:string,authority:string,score:double>>,
facets map<string,string>,
structured array<struct<schemaOrgType:string,slots:array<struct<name:string,value:string>>,steps:array<struct<`order`:int,text:string>>>>,
claims array<struct<statement:string>>"""

EVIDENCE = "struct<channel:string,assertion_mode:string,confidence:double,source_role:string,quote:string,t_start:double,t_end:double>"

EXTRACTOR_OUTPUT = f"""mentions array<struct<surface:string,type:string,aliases:array<string>,evidence:array<{EVIDENCE}>>>,
concepts array<struct<surface:string,evidence:array<{EVIDENCE}>>>,
facets array<struct<facet:string,value:string,evidence:array<{EVIDENCE}>>>,
claims array<struct<statement:string,evidence:array<{EVIDENCE}>>>,
structured array<struct<schemaOrgType:string,slots:array<struct<name:string,value:string>>,steps:array<struct<`order`:int,text:string>>,evidence:array<{EVIDENCE}>>>"""

ITEM_FIELDS = (
    ("id", "string"), ("sources", "array<string>"), ("desc", "string"), ("createTime", "long"), ("author", "string"), ("authorName", "string"), ("url", "string"), ("playUrl", "string"),
    ("downloadUrl", "string"), ("cover", "string"), ("durationSec", "double"), ("hasSubtitles", "boolean"), ("subtitleUrl", "string"), ("isSlideshow", "boolean"),
    ("music", "struct<name:string,author:string>"), ("hashtags", "array<string>"), ("stats", "struct<plays:long,likes:long,comments:long,shares:long,collects:long>"),
)
ITEM = ", ".join(f"`{name}` {kind}" for name, kind in ITEM_FIELDS)
PAGE = f"source string, url string, hasMore string, cursor string, items array<struct<{','.join(f'`{name}`:{kind}' for name, kind in ITEM_FIELDS)}>>"

JOB = "id string, itemId string, status string, attempts int, nextAttemptAt long, lastError string"

# The nine groundable types and the authorities each is grounded to, first choice first.
TYPE_AUTHORITIES = {
    "music_recording": "musicbrainz",
    "place": "google_places",
    "screen_work": "wikidata",
    "book": "wikidata / openlibrary",
    "person": "wikidata",
    "product": "wikidata",
    "brand_org": "wikidata",
    "software_app": "wikidata",
    "game": "wikidata",
}
TYPES = tuple(TYPE_AUTHORITIES)

# Channels and assertion modes (modes strongest first), media kinds, save kinds, capture sources in sweep order.
CHANNELS = ("VERBAL_AUDIO", "VERBAL_TEXT", "VISUAL_SCENE", "VISUAL_TEXT", "NONVERBAL_AUDIO", "STRUCTURED_METADATA")
MODES = ("STATED", "SHOWN", "REPORTED", "INFERRED")
MEDIA_KINDS = ("photo", "video", "audio", "document", "rich", "link", "file")
IDENTITY_STATUSES = ("platform_verified", "inferred", "synthetic")
SAVE_KINDS = ("favorites", "likes", "bookmark", "upload", "repost", "watch_later", "screenshot", "manual", "other")
SOURCES = ("favorites", "likes", "posts", "reposts")

# The facet vocabulary, nine axes.
FACETS = {
    "topic": ("food", "travel", "fitness", "fashion", "tech", "finance", "home", "entertainment", "education", "other"),
    "intent": ("how_to", "review", "recommendation", "haul", "demo", "meme", "explainer", "storytime", "news", "inspiration", "other"),
    "genre": ("tutorial", "vlog", "skit", "edit", "compilation", "reaction", "interview", "documentary", "performance", "slideshow", "other"),
    "affect": ("funny", "heartwarming", "motivational", "calming", "exciting", "sad", "outrage", "awe", "cringe", "neutral"),
    "creator_role": ("expert", "enthusiast", "brand", "journalist", "entertainer", "educator", "unknown"),
    "viewer_orientation": ("do", "buy", "go", "watch", "learn", "feel", "save_for_later"),
    "presentation": ("talking_head", "voiceover", "text_overlay", "cinematic", "tutorial_demo", "skit", "compilation", "reaction", "slideshow", "before_after", "pov", "room_tour", "outfit_showcase", "edit", "other"),
    "content_provenance": ("original", "repost", "clipped", "ai_generated", "ai_assisted", "unknown"),
    "actionability": ("genuine_rec", "informational", "entertainment_only", "promotional", "ragebait_suspect"),
}
CONTRACT_VERSION = "1.0.0-rc.6"
