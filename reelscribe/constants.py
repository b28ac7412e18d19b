"""Fixed values that results depend on. Pixels unless said otherwise."""

# Anchors between neighbouring frames.
SHIFT_TOLERANCE = 3.0
BAND_HEIGHT = 20.0
FIXED_RATIO = 0.8
MIN_KEY_LENGTH = 4
MIN_ANCHORS = 3
MIN_VOTE = 0.4
FUZZY_SIMILARITY = 0.9
RESCUE_VOTE = 0.6
# Merging sightings of a line.
DEDUPE_WINDOW = 90.0
SAME_BOX_OVERLAP = 0.6
VARIANT_SIMILARITY = 0.8
MAJORITY = 3
# Chat bubbles.
ALIGN_TOLERANCE = 30.0
BUBBLE_DY = 62.0
BUBBLE_DX = 60.0
WHITE_FLOOR = 245.0
GREEN_LEAD = 40.0
# Text layout.
SPATIAL_DY = 20.0
SPATIAL_DX = 40.0
ROW_DY = 18.0
REPEAT_LENGTH = 8
REPEAT_WINDOW = 40
# Pixel search.
SUBSAMPLE = 4
TEMPLATE_TOP = 60
TEMPLATE_HEIGHT = 300
REFINE = 24
# Planning.
FRAMES_PER_SECOND = 4.0
OCR_HEIGHT = 1400
OCR_OVERLAP = 200
PRESETS = {
    "chat": {"pre_scan": 12, "mode": "chat", "stride": 5},
    "comments": {"pre_scan": 24, "mode": "plain", "stride": 3},
    "generic": {"pre_scan": 24, "mode": "plain", "stride": 3},
}
THUMBNAIL_QUALITY = {"prescan": 0.4, "shift": 0.4, "keyframe": 1.0}
# Timing parts that must add up.
SHIFT_PARTS = ["shiftThumbMs", "decodeMs", "grayMs", "shiftMs", "keyframeMs", "pauseMs"]
ANCHOR_PARTS = ["frameExtract", "frameOcr", "uiPause", "anchorLayout", "speakerSampling", "markdown", "cleanup"]
# Text classes (ECMAScript white space, and what comparisons ignore).
WHITE = r"\t\n\r\f\x0B \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
IGNORED = WHITE + "，。、,.…\"'"
SCORE_IGNORED = IGNORED + "“”"
TIME_LABEL = rf"^(昨天[{WHITE}]*)?[0-9]{{1,2}}[:：][0-9]{{2}}$"
SELF, OTHER = "我", "对方"
VISUAL_MESSAGE = r"^\[(图片|表情|Facepalm|Lol|视频|动画表情)\]+$"
