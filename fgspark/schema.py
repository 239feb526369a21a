"""Schemas of the tables that hold factor graphs. Tables of a factor are listed with its first variable fastest."""

FACTOR_TYPE = "model_id string, name string, kind string, card array<int>, stride array<bigint>, prod_card bigint, data_size int, w array<double>, tie array<int>, rbf_n int, log_beta double"
VARIABLE = "graph_id bigint, var_id int, card int"
FACTOR = "graph_id bigint, factor_id int, type string, vars array<int>, data array<double>, data_idx array<int>, dsrc_id int"
DATA_SOURCE = "graph_id bigint, dsrc_id int, data array<double>, data_idx array<int>"
SCOPE = "graph_id bigint, factor_id int, pos int, var_id int, card int, stride bigint"
ENERGY = "graph_id bigint, factor_id int, ei bigint, energy double"
OBS_STATE = "graph_id bigint, var_id int, state int"
OBS_EXP = "graph_id bigint, factor_id int, ei bigint, p double"
PRIOR = "type string, prior string, params array<double>"
MARGINAL = "graph_id bigint, factor_id int, ei bigint, p double"
LOG_Z = "graph_id bigint, log_z double"
SAMPLE = "graph_id bigint, sample_id bigint, var_id int, state int"
STATE = "graph_id bigint, var_id int, state int, energy double"
#: Entries that a factor's table may have.
MAX_TABLE = 1 << 20
