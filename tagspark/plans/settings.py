"""Parameters of the registered queries, shared by both engines."""

MIN_DF = 0.01
N_TAGS = 50
TRAIN_TAGS = 4
BINS = 5
# Width of the projections whose cells are returned one by one, and of the whole ones.
PROJECTION_DIMS = 64
WIDE_DIMS = 4000
NOISE_PASSES = 400
NOISE_BATCH = 200
# Multiples (in tenths) of the weights that stand for scored iterations.
SCORED_STEPS = (10, 20, 30, 40)
# Iterations, how often they are scored, and mini-batches of the trainings.
TAG_TRAINING = (10, 5, 2)
MARGIN_TRAINING = (6, 3, 1)
MARGIN_STEP_RATE = 0.001
MARGIN_NOISE_SEED = 7
ALL_TRAINING = (700, 10, 1)
# Ranks of the tags whose occurrences are read.
RUN_RANKS = (2, 17)
