"""Colour names and palettes. All of these are fixed values."""

# Named display colours.
CHANNEL_COLOURS = {
    "Blue (DAPI)": (0, 100, 255),
    "Green (FITC)": (0, 255, 0),
    "Red (Cy5)": (255, 0, 0),
    "Orange": (255, 165, 0),
    "Magenta (Cy3)": (255, 0, 255),
    "Cyan": (0, 255, 255),
    "Yellow": (255, 255, 0),
    "White": (255, 255, 255),
    "Hot Pink": (255, 50, 120),
    "Lime": (180, 255, 0),
    "Teal": (0, 200, 180),
    "Coral": (255, 100, 80),
    "Violet": (160, 50, 255),
    "Sky Blue": (100, 200, 255),
    "Gold": (255, 215, 0),
    "Salmon": (255, 140, 105),
    "Spring Green": (0, 255, 160),
    "Deep Pink": (255, 20, 147),
    "Turquoise": (64, 224, 208),
    "Orchid": (218, 112, 214),
    "Khaki": (240, 230, 140),
    "Tomato": (255, 99, 71),
    "Aquamarine": (127, 255, 212),
    "Plum": (221, 160, 221),
    "Chartreuse": (127, 255, 0),
    "Sienna": (255, 130, 71),
    "Pale Green": (152, 251, 152),
    "Medium Blue": (0, 80, 200),
    "Light Coral": (240, 128, 128),
    "Steel Blue": (100, 149, 237),
    "Peru": (205, 133, 63),
    "Sea Green": (60, 179, 113),
    "Slate Blue": (106, 90, 205),
    "Dark Orange": (255, 140, 0),
    "Olive": (128, 180, 0),
    "Indian Red": (205, 92, 92),
    "Cadet Blue": (95, 158, 160),
    "Lawn Green": (124, 252, 0),
    "Medium Orchid": (186, 85, 211),
    "Sandy Brown": (244, 164, 96),
    "Light Sea": (32, 178, 170),
    "Dodger Blue": (30, 144, 255),
    "Fire Brick": (178, 34, 34),
    "Medium Aqua": (102, 205, 170),
    "Royal Blue": (65, 105, 225),
    "Dark Salmon": (233, 150, 122),
    "Pale Violet": (219, 112, 147),
    "Dark Cyan": (0, 180, 180),
    "Bright Orange": (255, 176, 56),
    "Mint": (162, 255, 204),
    "Rose": (255, 102, 153),
}

# Colours of cell groups, by rank modulo their number.
GROUP_COLOURS = ((76, 217, 100), (255, 69, 58), (0, 122, 255), (255, 159, 10), (191, 90, 242), (255, 214, 10), (48, 209, 88), (94, 92, 230), (255, 55, 95), (100, 210, 255))

# Colours of phenotypes, by rank modulo their number.
PHENOTYPE_COLOURS = (
    "#0a84ff", "#30d158", "#ff453a", "#ff9f0a", "#bf5af2", "#64d2ff", "#ffd60a", "#ff375f", "#ac8e68", "#00c7be",
    "#5e5ce6", "#ff6482", "#98c379", "#e5c07b", "#c678dd", "#56b6c2", "#e06c75", "#d19a66", "#61afef", "#be5046",
)
