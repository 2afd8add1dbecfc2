"""Fixed values that results depend on: patterns, word lists, thresholds and default names."""

# Heading patterns and their levels, tried in this order.
HEADING_PATTERNS = [
    (1, r"^#{1}\s+(.+)$"),
    (1, r"^제\s*\d+\s*장\s*(.+)$"),
    (2, r"^제\s*\d+\s*절\s*(.+)$"),
    (2, r"^#{2}\s+(.+)$"),
    (1, r"^\d+\.\s+([A-Z가-힣].+)$"),
    (2, r"^\d+\.\d+\s+(.+)$"),
    (3, r"^\d+\.\d+\.\d+\s+(.+)$"),
    (1, r"^[IVX]+\.\s+(.+)$"),
    (2, r"^[A-Z]\.\s+(.+)$"),
]
# Paragraph openings that start a new semantic chunk.
SEMANTIC_BREAKS = [r"^제\s*\d+\s*[장절]", r"^\d+\.\s+[A-Z가-힣]", r"^#{1,3}\s+"]

# Section and chunk defaults.
WHOLE_DOCUMENT_HEADING = "Document Content"
SINGLE_SECTION_HEADING = "Forced Single Section"
BOUNDARY_HEADING = "SOP"
CHUNK_SIZE = 1000
CHUNK_OVERLAP = 200
MIN_SECTION_CHARS = 50

# Business key patterns, applied to upper-case text.
BUSINESS_KEY_PATTERNS = [
    r"\b[A-Z]{1,8}_[A-Z]{1,8}_[A-Z0-9]{2,}\b",
    r"\b[A-Z]{1,8}_BP_[A-Z0-9]{2,}\b",
    r"\bBP_[A-Z0-9]{2,}\b",
]

# Conjunction that splits task names, and particles ignored among core words.
CORE_CONJUNCTION = "및"
CORE_STOP_WORDS = ["및", "의", "을", "를", "이", "가", "에", "로", "으로", "와", "과", "에서", "부터", "까지"]

# Weights and cut-offs of process similarity.
WEIGHT_TASK, WEIGHT_ROLE, WEIGHT_DESC, WEIGHT_NARRATIVE, WEIGHT_NAME = 0.42, 0.16, 0.12, 0.24, 0.03
TASK_STRONG, TASK_STRONG_SCORE = 0.62, 0.9
KEY_SCORE, KEY_CONFLICT_FACTOR = 0.94, 0.75
SPARSE_TASK, SPARSE_NARRATIVE, SPARSE_ROLE, SPARSE_SCORE = 0.2, 0.45, 0.2, 0.72
ACCEPT, ACCEPT_SHARED_KEY, ACCEPT_SPARSE = 0.68, 0.55, 0.64

# Usual text caps of the evidence that feeds a process signature, for callers who want any.
TEXT_CAPS = {
    "process_chunk": 2000, "task_chunk": 1800, "snippet": 1200, "snippets": 10, "document": 5000, "evidence": 12000, "narrative": 4000, "conditions": 30,
}

# Entity resolution thresholds.
MERGE_AT, REVIEW_AT, NAME_CANDIDATES = 0.90, 0.80, 10

# Gateway naming.
GATEWAY_PLACEHOLDERS = ["분기", "gateway", "gw", "decision"]
GATEWAY_SUBJECT_PATTERNS = [r"(.+?)(?:인지|인가)\s*여부", r"(.+?)\s*여부"]
GATEWAY_NOISE_WORDS = ["분기", "판단", "확인", "검토", "결정", "여부"]
GATEWAY_NAME_SUFFIX = " 여부 판단"
GATEWAY_DEFAULT_NAME = "의사결정 분기 "
TRUE_SUFFIX, FALSE_SUFFIX = "인 경우", "이 아닌 경우"
TRUE_DEFAULT, FALSE_DEFAULT = "조건 충족인 경우", "조건 미충족인 경우"
GATEWAY_DEFAULT_SUBJECT, SATISFIED_SUFFIX = "해당 조건", " 충족인 경우"
SYNTHETIC_GATEWAY_DESCRIPTION = "조건 분기(자동 보강)"
BRANCH_WORD = "분기"

# Conditions that carry no meaning, compared in lower case without spaces.
PLACEHOLDER_CONDITIONS = [
    "조건1", "조건2", "조건3", "조건4", "조건5",
    "분기1", "분기2", "분기3",
    "case1", "case2", "case3",
    "hastask", "hasinstruction", "performedby", "hasgateway", "hasevent",
]
RELATION_CONDITIONS = ["hastask", "hasinstruction", "performedby", "hasgateway", "hasevent"]
PLACEHOLDER_CONDITION_PATTERN = r"^(조건|분기|case)\d+$"

# Markers of reusable expertise and of task-local wording.
SKILL_LOCAL_MARKERS = [
    "접수", "제출", "등록", "전달", "통보", "요청", "확인 후", "버튼", "클릭", "입력",
    "업로드", "다운로드", "시스템", "화면", "메뉴", "양식 작성", "문서 작성", "작성 및 제출",
]
SKILL_REUSABLE_MARKERS = [
    "평가", "분석", "판독", "산정", "예측", "검증", "분류", "판단", "기준", "규정",
    "정책", "리스크", "위험도", "모델", "전략", "방법론", "체계", "기법", "해석",
]
SKILL_GENERIC_MARKERS = ["전문", "노하우", "역량"]

# Wording that needs a person, and wording that suggests automation.
HUMAN_WORDS = [
    "신청", "등록", "접수", "제출", "결재", "결제", "입금", "납부", "승인", "서명",
    "대면", "회의", "면담", "전화", "방문", "출석", "참석", "수령", "발급", "실물", "현장",
]
AUTOMATION_WORDS = [
    "자동", "에이전트", "봇", "생성", "요약", "정리", "분석", "검증", "추출", "조회", "검색",
    "분류", "추천", "채점", "퀴즈", "문항", "리포트", "보고서", "취합", "집계",
]

# Know-how folding.
KNOWHOW_DECISION, KNOWHOW_DECISION_SUFFIX = "업무 판단 기준", " 판단 기준"
KNOWHOW_WHEN, KNOWHOW_CONFIDENCE = "업무 수행 시", 0.8
KNOWHOW_DESCRIPTION, KNOWHOW_OUTPUT = "문서 내 전문지식/판단기준에서 자동 보강", "판단 결과"

# Default names of model elements.
START_NAME, END_NAME, DEFAULT_ROLE = "프로세스 시작", "프로세스 종료", "담당자"
ACTIVITY_DEFAULT, OUTPUT_SUFFIX, OUTPUT_DEFAULT = "활동 ", " 결과", "결과"
DECISION_DEFAULT_NAME, DECISION_DESC_SUFFIX, RULE_THEN_SUFFIX = "분기 의사결정", "에 대한 분기 판단", " 경로 선택"
DEFAULT_DURATION = 5

# How steps are marked in a text.
NUMBERED_STEP = r"\d+[.)\s]+(.+?)(?=\d+[.)\s]|$)"
BULLET_STEP = r"[-•]\s*(.+?)(?=[-•]|$)"
SENTENCE_END = r"[.。]\s*"

# Skill documents.
SKILL_SUFFIX = " Skill"
SKILL_PURPOSE_SUFFIX = " 태스크를 수행합니다."
SKILL_DEFAULT_STEP = "작업을 수행합니다."
SKILL_EXCEPTIONS = ["오류 발생 시 재시도", "실패 시 상위 보고"]

# Form field tags; tags of an editor's own are the caller's to add.
FORM_TAGS = [
    "text-field", "select-field", "checkbox-field", "radio-field", "file-field", "label-field",
    "boolean-field", "textarea-field", "user-select-field", "report-field", "slide-field",
]

# Skill assignment.
ACTIVITY_SKILL_AT, AGENT_SKILL_AT, SKILLS_PER_MATCH = 0.35, 0.22, 5
# Catalogue group of unplaced processes.
UNCLASSIFIED = "미분류"
# Share of tasks that should have a role.
ROLE_COVERAGE = 0.3
# Ends of a job.
TERMINAL_STATUSES = ["completed", "failed", "error"]
