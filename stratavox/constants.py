"""Thresholds of the timeline operators. Changing one changes results; raise REVISION then, so that outputs are rebuilt."""

REVISION = 8
#: Begins the comment line that ends an output. Outputs with another marker are read by setting it.
MARKER = "<!-- timeline:"

# speech
GAP_S, SOFT_S, SOFT_CHARS, HARD_S, HARD_CHARS = 2.0, 20.0, 300, 45.0, 650
MIN_LOGPROB, MAX_NO_SPEECH, REPEATS, PHRASE_CHARS = -0.9, 0.6, 3, 12
VAD_NOTICE = 0.15
COMPLETE = 0.98

# screens
MIN_CONF, MIN_CONTENT, TOP_TOLERANCE = 60, 0.55, 25
MERGE_SHARE, LOOK_BACK = 0.55, 3
NEAR_S, SUBTITLE_LINES, SUBTITLE_CHARS, SUBTITLE_SHARE = 25, 3, 90, 0.6
SPAN_PAD_S, SPAN_SLIDES = 15, 2
MIX_COST, HANGUL_BONUS, LENGTH_GAIN = 12, 8, 0.2
TITLE_LINES, TITLE_CHARS = 4, 60

# materials
MIN_BIGRAMS, SHORT_BIGRAMS = 5, 12
MATCH_SHARE, SHORT_SHARE = 0.35, 0.60
FORWARD_BONUS, FORWARD_PAGES = 0.04, 12
NAME_SHARE = 0.50
HOTWORD_CHARS = 320

# names
NAME_CHARS = 120
MEDIA = sorted("3gp aac amr avi flac m4a m4v mkv mov mp2 mp3 mp4 mpeg mpg mts ogg opus ts wav webm wma wmv".split())
SLIDE, SUBTITLE = "슬라이드", "자막"

#: Signs that count as content in a recognised line, beside letters and digits.
SIGNS = "".join(sorted("·∙↓↑←→≥≤≠÷×±£€$₩\"':;,.~|[](){}<>^%/*=-+"))
#: Function words that are no terms of a subject.
COMMON = frozenset(
    "경우 것을 것이 그래서 그러나 그리고 다음 대한 되는 등의 때문 때문에 또는 수가 여러분 우리 위한 이러한 이상 이하 있는 있다 지원 하는 하지만 한다".split()
)
