"""Fixed values.

Results depend on these exact words, numbers and patterns, so they are stated
as they are and in one place.
"""

# Brand name -> local-language name used in search phrases.
BRAND_ALIAS = {
    "zara": "자라",
    "8seconds": "에잇세컨즈",
    "musinsa": "무신사",
    "uniqlo": "유니클로",
    "topten": "탑텐",
}

# Words that never count as a core keyword of a product name.
NAME_STOPWORDS = (
    "zara", "자라", "8seconds", "에잇세컨즈", "여성", "남성", "여자", "남자", "공용", "남녀공용", "신상", "정품",
)

# Attribute keys holding one of these are notices, not material.
NOTICE_WORDS = (
    "유의사항", "분쟁해결", "책임자", "환불", "반품", "교환", "배송", "접수방법", "라벨", "SSF SHOP", "매장픽업",
)

# Resale and import marks in an offer title.
SPAM_WORDS = ("구매대행", "구제", "중고", "병행수입")

# Offer acceptance.
SIMILARITY_FLOOR = 0.35
SIMILARITY_FLOOR_WITH_CODE = 0.175
PRICE_LOW, PRICE_HIGH = 0.3, 2.5
REFINE_LOW, REFINE_HIGH = 0.4, 2.0
OFFERS_KEPT = 5
QUERY_KINDS = ("ko_name", "en_name", "ko_code", "en_code")

# Category words and what they are searched as.
CATEGORY_SEARCH_ALIAS = {
    "top": ("top", "Top", "상의"),
    "bottom": ("bottom", "Bottom", "하의"),
    "outer": ("outer", "Outer", "아우터"),
    "상의": ("상의", "top", "Top"),
    "하의": ("하의", "bottom", "Bottom"),
    "아우터": ("아우터", "outer", "Outer"),
}
CATEGORY_CODE_ALIAS = {
    "top": ("top", "상의"),
    "bottom": ("bottom", "하의"),
    "outer": ("outer", "아우터"),
}

# Detector class -> category.
DETECTED_CATEGORY = {
    "top": "Top",
    "상의": "Top",
    "bottom": "Bottom",
    "하의": "Bottom",
    "outer": "Outer",
    "아우터": "Outer",
}

# Vector search.
IMAGE_K, TEXT_K, FINAL_K = 300, 500, 6
IMAGE_WEIGHT, TEXT_WEIGHT = 0.7, 0.3
RRF_K = 60

# Log level ranks.
LEVEL_RANK = {"CRITICAL": 4, "ERROR": 3, "WARN": 2, "INFO": 1}

# Lower-case message parts seen while services start.
STARTUP_NOISE = (
    "incompatible clusterids",
    "initialization failed for block pool",
    "all specified directories have failed to load",
    "datanode registration failed",
    "warn datanode",
    "namenode is in safe mode",
    "broker is not available",
    "nobrokersavailable",
    "error while fetching metadata",
    "leader not available",
    "notleaderforpartitionerror",
    "scheduler is not running",
    "dag file processor manager",
    "connection refused",
    "connection reset by peer",
    "failed to connect",
    "temporary failure in name resolution",
)

# Container -> service.
CONTAINER_SERVICE = {
    "airflow-webserver-main": "Airflow",
    "airflow-scheduler-main": "Airflow",
    "spark-master-main": "Spark",
    "spark-worker-1-main": "Spark",
    "namenode-main": "Hadoop",
    "datanode-main": "Hadoop",
    "kafka-main": "Kafka",
    "zookeeper-main": "Kafka",
    "postgres-main": "DB",
    "mongo-main": "DB",
    "redis-main": "DB",
    "elasticsearch-main": "Elastic",
    "fastapi-main": "API_BE",
    "ml-engine-main": "API_ML",
}

# Shipper rules (lines kept by container, chatter dropped).
CORE_CONTAINERS = (
    "airflow-scheduler-main",
    "airflow-webserver-main",
    "spark-master-main",
    "fastapi-main",
    "postgres-main",
    "kafka-main",
)
CHATTER = (
    "GET /health",
    "healthcheck",
    "GET /api/logs",
    "org.apache.hadoop",
    "java.lang.Thread",
    "Connection ended",
    "Connection accepted",
    "client metadata",
    "Storage:",
    "Block pool",
    "DatanodeHttpServer",
)
STACK_FRAME = r"^\s+at "
KEEP_MARKS = ("ERROR", "Exception", "Failed", "CRITICAL")

# Alerting and recovery.
CRITICAL_COOLDOWN_S = 60
SPIKE_COOLDOWN_S, SPIKE_WINDOW_S, SPIKE_THRESHOLD = 300, 600, 15
RATE_WINDOW_S, RATE_MAX, CIRCUIT_OPEN_S = 300, 10, 1800
STARTUP_GRACE_S = 300
RECOVERY_WINDOW_S, RECOVERY_THRESHOLD = 300, 10
RECOVERY_COOLDOWN_S, RECOVERY_PER_HOUR = 120, 3

# Files and display.
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "webp")
MIN_IMAGE_BYTES = 5120
MIN_IMAGE_PIXELS = 10
PLACEHOLDER_IMAGE = "https://placehold.co/300x300?text=No+Image"
DEFAULT_MALL, DEFAULT_MALL_URL = "공식몰", "#"
NO_RESULT = "결과 없음"
IN_STOCK_QTY = 999

# Text patterns.
KEEP_LETTERS = "가-힣a-zA-Z0-9"
IMAGE_NAME = r"(?i)^([^_]+)_(Men|Women)_(Top|Bottom|Outer)_([^_]+)(?:_.*)?$"
HTTP_FINE = r'HTTP/1\.[01]" [23]\d{2}'
CONTAINER_ID_IN_PATH = r"containers/([a-f0-9]{64})"
CONTAINER_IN_TEXT = r"([\w-]+-main)"
MODEL_CODE = r"\b[A-Z]{1,5}\d{6,}\b"
EMBEDDING_TEMPLATE = "브랜드: %s, 성별: %s, 카테고리: %s, 상황: %s, 설명: %s"
