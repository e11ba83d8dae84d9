"""The normalised tables: their keys, columns and fixed vocabularies.

A record is one recording; an epoch is one fixed-length slice of it. Time is ``epoch_idx``; order is always a column.
"""

from __future__ import annotations

# Schemas are DDL strings, as Spark's readers take them.

#: Key of an epoch.
RECORD = ("dataset", "subject_id")

SUBJECTS = "dataset string, subject_id int, record_id string, num_windows int, start_index bigint, end_index bigint, grp string, age double, sex int"
FOLDS = "dataset string, subject_id int, fold int, split string"
EPOCHS = "dataset string, subject_id int, epoch_idx int, channel string, samples array<float>"
SPECTRA = "dataset string, subject_id int, epoch_idx int, channel string, spec array<array<float>>"
LABELS = "dataset string, subject_id int, epoch_idx int, stage int"
SCALING = "dataset string, prep string, channel string, pos int, mean double, std double"
ANNOTATIONS = "dataset string, record_id string, onset_s double, duration_s double, code string"
PREDICTIONS = "dataset string, subject_id int, rel_idx int, off int, logits array<double>"

# Stages, split names, the label that pads a short sequence, and the order of channels.
HUMAN_STAGES = {"W": 0, "N1": 1, "N2": 2, "N3": 3, "REM": 4}
RODENT_STAGES = {"W": 0, "NREM": 1, "REM": 2}
SPLITS = ("train", "valid", "test")
PAD_STAGE = 5
UNSCORED = -1
CHANNELS = ("EEG", "EOG", "EMG", "ECG")
SEQUENCE_LENGTH = 21

# Samples per epoch, seconds per epoch and sampling rate by kind of subject.
HUMAN_EPOCH = (3000, 30, 100)
MOUSE_EPOCH = (400, 4, 100)
RAT_EPOCH = (512, 4, 128)
