"""Fixed values of the analysis: thresholds, codes, names and model grids."""

from __future__ import annotations

# Biological index tags.
INDICES = ["csci", "asci"]

# Channel engineering classes and the three overall classes.
CHANNEL_CLASSES = ["NAT", "SB0", "SB1", "SB2", "HB"]
OVERALL_CLASSES = ["NATLow", "NATMed", "NATHigh"]
LIMIT_CLASSES = ["NAT", "NATMed", "NATLow", "NATHigh", "HB", "SB0", "SB2"]

# Flow metric columns and their codes.
METRIC_CODES = {
    "d_ds_mag_50": "DS_Mag_50",
    "d_fa_mag": "FA_Mag",
    "d_peak_10": "Peak_10",
    "d_peak_2": "Peak_2",
    "d_peak_5": "Peak_5",
    "d_sp_mag": "SP_Mag",
    "d_wet_bfl_mag_10": "Wet_BFL_Mag_10",
    "d_wet_bfl_mag_50": "Wet_BFL_Mag_50",
    "delta_q99": "Q99",
}
FLOW_METRICS = list(METRIC_CODES)
PEAK_METRICS = ["d_peak_10", "d_peak_2", "d_peak_5", "delta_q99"]

# Biological threshold per index and limit class. SB1 has none.
BIO_THRESHOLDS = {
    "asci": {"NAT": 0.86, "NATMed": 0.86, "NATLow": 0.75, "NATHigh": 0.94, "HB": 0.87, "SB0": 0.79, "SB2": 0.76},
    "csci": {"NAT": 0.79, "NATMed": 0.79, "NATLow": 0.63, "NATHigh": 0.92, "HB": 0.67, "SB0": 0.78, "SB2": 0.75},
}

# One standard threshold per index, and the per-class thresholds of the
# logistic models (these do include SB1).
STANDARD_THRESHOLDS = {"csci": 0.79, "asci": 0.86}
CONDITION_THRESHOLDS = {
    "csci": {"SB0": 0.78, "SB1": 0.78, "SB2": 0.75, "HB": 0.67, "NAT": 0.79},
    "asci": {"SB0": 0.79, "SB1": 0.79, "SB2": 0.76, "HB": 0.87, "NAT": 0.86},
}

# Report names of the limit classes.
CLASS_NAMES = {
    "HB": "Hard Bottom",
    "NAT": "Natural",
    "NATHigh": "Overall 1st",
    "NATLow": "Overall 30th",
    "NATMed": "Overall 10th",
    "SB0": "Soft Bottom (no hard sides)",
    "SB2": "Soft Bottom (two hard sides)",
}

# Long names of the channel classes, in display order.
CHANNEL_NAMES = {
    "NAT": "Natural",
    "SB0": "Soft: Zero Hard Sides",
    "SB1": "Soft: One Hard Side",
    "SB2": "Soft: Two Hard Sides",
    "HB": "Hard Bottom",
}

# Outcomes in order, and their names on reports.
OUTCOMES = ["NoImpact", "BioImpact", "HydroImpact", "BothImpact"]
OUTCOME_NAMES = {
    "NoImpact": "Bio & Flow Within Range",
    "BioImpact": "Low Bio",
    "HydroImpact": "Altered Flow",
    "BothImpact": "Low Bio & Altered Flow",
}

# Model grids.
SMOOTHS = [3, 6, 9, 12, 15, 18, 20]
QUANTILES = [0.99, 0.90, 0.70, 0.50]
LINE_QUANTILES = [0.9, 0.8, 0.5, 0.2, 0.1]

# Metrics that use basis size 6; the others use 3. Quantiles kept.
SMOOTH_SIX = {"csci": ["DS_Mag_50", "FA_Mag"], "asci": ["DS_Mag_50", "FA_Mag", "SP_Mag"]}
CHOSEN_QUANTILES = [0.9, 0.5]

# Curves that stay above, or below, every threshold they do not cross.
ABOVE_CURVES = ["csci_SP_Mag_3_0.9", "csci_Wet_BFL_Mag_50_3_0.9"]
BELOW_CURVES = [
    "asci_DS_Mag_50_6_0.5",
    "asci_FA_Mag_6_0.5",
    "asci_Peak_10_3_0.5",
    "asci_Peak_2_3_0.5",
    "asci_Peak_5_3_0.5",
    "asci_Wet_BFL_Mag_10_3_0.5",
    "asci_Wet_BFL_Mag_50_3_0.5",
    "asci_Q99_3_0.5",
]

# The label row that the label file lacks.
Q99_LABEL = ("Peak Flow Magnitude (Q99, cfs)", "Q99", "Peak Flow Magnitude")
LABEL_ROWS = 24
