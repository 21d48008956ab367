"""Constants of the computation.

--- fixed values: these must equal the reference's for identical results ---
"""

DEFAULT_THRESHOLD = 0.5     # a detection is kept when score > threshold
GROUPING_TOLERANCE = 10.0   # pixels: row / column grouping gap and span closing
TEXT_OVERLAP = 0.3          # a text belongs to a cell when intersection / text area > this
TABLE_SCALE = 2.0           # page render scale for table crops (144 dpi)
LAYOUT_PAGE_SCALE = 1.5     # page render scale for the layout model
CELL_INPUT = 640            # cell detector input edge (pixels)
LAYOUT_INPUT = 800          # layout detector input edge (pixels)
DETECTION_SLOTS = 300       # rows per image of a fixed-slot detector
CLS_RESIZE_SHORT = 256      # classifier: shorter edge after resize
CLS_CROP = 224              # classifier: centre crop edge
CLS_MEAN = (0.485 * 255.0, 0.456 * 255.0, 0.406 * 255.0)                       # per stored channel (B, G, R)
CLS_SCALE = (1.0 / (255.0 * 0.229), 1.0 / (255.0 * 0.224), 1.0 / (255.0 * 0.225))  # per stored channel
SCORE_TOLERANCE = 0.01      # verification: absolute, strict
POSITION_TOLERANCE = 5      # verification: pixels, absolute, strict
READING_ORDER_ROW_WEIGHT = 100  # reading-order key l + 100 * t
