"""Fixed values and defaults shared by the operators."""

#: Extensions of the two kinds of image file.
JPEG_EXTENSIONS = ["jpg", "jpeg"]
RAW_EXTENSIONS = [
    "3fr", "arw", "cr2", "cr3", "crw", "dng", "erf", "iiq", "kdc", "mos", "mrw", "nef", "nrw",
    "orf", "pef", "raf", "rw2", "rwl", "sr2", "srf", "srw", "x3f",
]

#: Colour labels by number.
LABELS = ["None", "Red", "Yellow", "Green", "Blue", "Purple"]

#: Profile sections that belong to a shot, not to its look.
SHOT_SECTIONS = [
    "General", "Version", "Crop", "Resize", "Rotation", "Perspective", "Coarse", "LensProfile", "Film Negative", "RAW",
]
METADATA, WHITE_BALANCE = "MetaData", "White Balance"

#: Named colours.
COLOURS = {
    "black": (0, 0, 0), "noir": (0, 0, 0),
    "white": (255, 255, 255), "blanc": (255, 255, 255),
    "grey": (128, 128, 128), "gray": (128, 128, 128), "gris": (128, 128, 128),
    "red": (224, 32, 32), "rouge": (224, 32, 32),
    "orange": (255, 140, 26),
    "yellow": (255, 213, 0), "jaune": (255, 213, 0),
    "green": (34, 177, 76), "vert": (34, 177, 76),
    "cyan": (0, 200, 215),
    "blue": (40, 80, 224), "bleu": (40, 80, 224),
    "violet": (138, 43, 226), "purple": (138, 43, 226),
    "magenta": (224, 32, 192),
    "pink": (255, 105, 180), "rose": (255, 105, 180),
}

#: Upper bounds of hues in degrees and their names; beyond the last it is red again.
HUE_NAMES = [(15, "rouge"), (45, "orange"), (70, "jaune"), (160, "vert"), (200, "cyan"), (260, "bleu"), (300, "violet"), (345, "rose"), (360, "rouge")]

BURST_GAP_MS = 300
CLUSTER_THRESHOLD, TIME_WEIGHT, TIME_SCALE_MS = 0.2, 0.7, 600_000
WEIGHT_COLOUR, WEIGHT_LAYOUT, WEIGHT_TINT = 1.0, 1.0, 0.0
DARK, BINS = 48, 4
