"""Fixed values of the standards that the formulas use."""

# Hearing thresholds of narrow bands in a diffuse field (dB), third octaves of 20 Hz to 20 kHz.
HEARING_THRESHOLDS = [78.1, 68.7, 59.5, 51.1, 44.0, 37.5, 31.5, 26.5, 22.1, 17.9, 14.4, 11.4, 8.4, 5.8, 3.8, 2.1, 1.0, 0.8, 1.9, 0.5, -1.5, -3.1, -4.0, -3.8, -1.8, 2.5, 6.8, 8.4, 14.4, 43.7, 70.4]
# A-weighting of the same bands (dB).
A_WEIGHTS = [-50.5, -44.7, -39.4, -34.6, -30.2, -26.2, -22.5, -19.1, -16.1, -13.4, -10.9, -8.6, -6.6, -4.8, -3.2, -1.9, -0.8, 0.0, 0.6, 1.0, 1.2, 1.3, 1.2, 1.0, 0.5, -0.1, -1.1, -2.5, -4.3, -6.6, -9.3]
# Loudness thresholds in quiet of the 53 half-Bark bands.
QUIET = [0.3310, 0.1625, 0.1051, 0.0757, 0.0576, 0.0453, 0.0365, 0.0298, 0.0247, 0.0207, 0.0176, 0.0151, 0.0131, 0.0115, 0.0103, 0.0093, 0.0086, 0.0081, 0.0077, 0.0074, 0.0073, 0.0072, 0.0071, 0.0072, 0.0073, 0.0074, 0.0076, 0.0079, 0.0082, 0.0086, 0.0092, 0.0100, 0.0109, 0.0122, 0.0138, 0.0157, 0.0172, 0.0180, 0.0180, 0.0177, 0.0176, 0.0177, 0.0182, 0.0190, 0.0202, 0.0217, 0.0237, 0.0263, 0.0296, 0.0339, 0.0398, 0.0485, 0.0622]
# Exponents of the loudness non-linearity; its pressure thresholds are 15 to 85 dB in steps of 10.
LOUDNESS_V = [1, 0.6602, 0.0864, 0.6384, 0.0328, 0.4068, 0.2082, 0.3994, 0.6434]
LOUDNESS_CAL, LOUDNESS_CALX, LOUDNESS_ALPHA = 0.0211668, 1.00132, 1.5
# Coefficients of the masked-threshold polynomial in log10(f), highest power first, below 1 kHz (else -3 dB).
MASKED = [4.4683421395470813, -49.680265975480935, 212.89091871289099, -418.88552055717832, 317.07466358701885]
# Phon and sone of one piecewise linear curve.
PHON = [-5, -2.5, -1, 0, 0.5, 1, 1.5, 2, 2.2, 3, 3.5, 4, 4.5, 5, 5.5, 6, 6.5, 7.5, 8.5, 10, *[12.5 + 2.5 * i for i in range(48)]]
SONE = [0, 0.006664553571277, 0.010353620223062, 0.0131728008755640, 0.0147017002514385, 0.0163155244479395, 0.0180184921907174, 0.0198149610248851, 0.0205607307792728, 0.0237064956262933, 0.0259708071223978, 0.0284830012871350, 0.0313141063933990, 0.0342960992261228, 0.0374356436074735, 0.0407395216419739, 0.0442146129328367, 0.0517062900971077, 0.0599666456395902, 0.0739198656236416, 0.102309687878046, 0.137973827735358, 0.182143060528872, 0.235170666512493, 0.296369339360974, 0.366110735736481, 0.444665058185281, 0.533067637132950, 0.630859834999549, 0.739628579303990, 0.861665973977183, 0.999999649261453, 1.15446083738014, 1.32574011950862, 1.51478530574131, 1.72345292664480, 1.95194293008535, 2.20302763638237, 2.48230837837064, 2.79349557288218, 3.14141044540974, 3.53640968939006, 3.98960969379179, 4.50464193047483, 5.09216519681601, 5.76494189010932, 6.53417875936521, 7.41860357207810, 8.43076700943934, 9.58630438005357, 10.9139993638759, 12.4391485682283, 14.2012670012497, 16.2487266878483, 18.6386457583573, 21.4505973020449, 24.7648343591600, 28.6875064462480, 33.3311039332838, 38.8344811939958, 45.3667890880497, 53.1261734359328, 62.3737509192457, 73.4272890171466, 86.6550077521385, 102.511893200588, 121.538024632640, 144.383251212679]
