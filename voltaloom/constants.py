"""Fixed values of the domain: names, bands and defaults that results depend on."""

# Channel numbers of the usual montage, aliases of regions, sides and genotypes.
CHANNEL_BY_NUMBER = {9: "LAud", 10: "LVis", 12: "LHip", 14: "LBar", 15: "LMot", 16: "RMot", 17: "RBar", 19: "RHip", 21: "RVis", 22: "RAud"}
REGIONS = {r: [r, r.lower(), r.upper()] for r in ("Aud", "Vis", "Hip", "Bar", "Mot")}
SIDES = {"L": ["left", "Left", "LEFT", "L ", " L"], "R": ["right", "Right", "RIGHT", "R ", " R"]}
GENOTYPES = {"WT": ["WT", "wildtype"], "KO": ["KO", "knockout"]}

# Frequency bands in Hz.
BANDS = {"delta": (1, 4), "theta": (4, 8), "alpha": (8, 13), "beta": (13, 25), "gamma": (25, 40)}
TOTAL_BAND = (1, 40)
LINE_HZ = 60
SAMPLE_RATE = 1000

# Features by shape, and plot orders.
LINEAR = ["rms", "ampvar", "psdtotal", "psdslope", "nspike", "logrms", "logampvar", "logpsdtotal", "lognspike"]
BANDED = ["psdband", "psdfrac", "logpsdband", "logpsdfrac"]
MATRIX = ["cohere", "zcohere", "imcoh", "zimcoh", "pcorr", "zpcorr"]
SPECTRUM = ["psd"]
FEATURES = LINEAR + BANDED + MATRIX + SPECTRUM
PLOT_ORDER = {
    "channel": ["average", "all", "LMot", "RMot", "LBar", "RBar", "LAud", "RAud", "LVis", "RVis", "LHip", "RHip"],
    "genotype": ["WT", "KO"],
    "sex": ["Male", "Female"],
    "isday": [True, False],
    "band": list(BANDS),
}
# Microvolts of a unit.
UNITS = {"µV": 1.0, "uV": 1.0, "mV": 1e3, "V": 1e6, "nV": 1e-3}
