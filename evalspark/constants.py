"""Fixed values that results must agree on.

Everything in this module is a closed vocabulary or literal text whose exact
value decides whether our tables equal the published ones: task names and
their order, display labels, answer patterns, prompt templates, target-module
suffixes, preset values and the published paper rows. Operators take these as
default arguments, so callers can pass other vocabularies.
"""

from __future__ import annotations

# --- FIXED VALUES: tasks, in semantic order (order breaks argmax ties) -------
TASKS: tuple[str, ...] = (
    "boolq",
    "piqa",
    "social_i_qa",
    "hellaswag",
    "winogrande",
    "ARC-Easy",
    "ARC-Challenge",
    "openbookqa",
)

# --- FIXED VALUES: display labels ---------------------------------------------
TASK_LABELS: dict[str, str] = {
    "boolq": "BoolQ",
    "piqa": "PIQA",
    "social_i_qa": "Social IQA",
    "hellaswag": "HellaSwag",
    "winogrande": "WinoGrande",
    "ARC-Easy": "ARC-Easy",
    "ARC-Challenge": "ARC-Challenge",
    "openbookqa": "OpenBookQA",
}
SCOPES: tuple[str, ...] = ("full", "attention_only", "mlp_only")
SCOPE_LABELS: dict[str, str] = {
    "full": "Full",
    "attention_only": "Attention only",
    "mlp_only": "MLP only",
}
METHODS: tuple[str, ...] = ("lora", "dora")
METHOD_LABELS: dict[str, str] = {"lora": "LoRA", "dora": "DoRA"}

# --- FIXED VALUES: adapter target suffixes per scope ---------------------------
TARGET_MODULES: dict[str, tuple[str, ...]] = {
    "full": ("q_proj", "k_proj", "v_proj", "up_proj", "down_proj"),
    "attention_only": ("q_proj", "k_proj", "v_proj"),
    "mlp_only": ("up_proj", "down_proj"),
}

# --- FIXED VALUES: answer-extraction patterns per task --------------------------
ANSWER_PATTERNS: dict[str, str] = {
    "boolq": r"\b(true|false)\b",
    "piqa": r"\b(solution[12])\b",
    "social_i_qa": r"\b(answer[1-5])\b",
    "ARC-Easy": r"\b(answer[1-5])\b",
    "ARC-Challenge": r"\b(answer[1-5])\b",
    "openbookqa": r"\b(answer[1-5])\b",
    "hellaswag": r"\b(ending[1-4])\b",
    "winogrande": r"\b(option[12])\b",
}

# --- FIXED VALUES: multiple-choice answer keys ----------------------------------
ANSWER_KEY_INDEX: dict[str, int] = {
    "A": 1, "B": 2, "C": 3, "D": 4, "E": 5,
    "1": 1, "2": 2, "3": 3, "4": 4, "5": 5,
}

# --- FIXED VALUES: instruction-following prompt wrapper --------------------------
PROMPT_WITH_INPUT_HEAD = (
    "Below is an instruction that describes a task, paired with an input that provides "
    "further context. Write a response that appropriately completes the request.\n\n"
)
PROMPT_NO_INPUT_HEAD = (
    "Below is an instruction that describes a task. Write a response that appropriately "
    "completes the request.\n\n"
)
PROMPT_INSTRUCTION = "### Instruction:\n"
PROMPT_INPUT = "### Input:\n"
PROMPT_RESPONSE = "### Response:\n"

# --- FIXED VALUES: benchmark instruction templates (text pieces, in order) --------
BOOLQ_HEAD = "Please answer the following question with true or false.\n\n"
BOOLQ_FORMAT = "Answer format: true/false"
PIQA_HEAD = "Choose the better solution to the goal.\n\n"
PIQA_FORMAT = "Answer format: solution1/solution2"
SOCIAL_HEAD = "Choose the best answer to the social commonsense question.\n\n"
SOCIAL_FORMAT = "Answer format: answer1/answer2/answer3"
HELLASWAG_HEAD = "Choose the best ending for the given context.\n\n"
HELLASWAG_FORMAT = "Answer format: ending1/ending2/ending3/ending4"
WINOGRANDE_HEAD = "Choose the best option to fill in the blank.\n\n"
WINOGRANDE_FORMAT = "Answer format: option1/option2"
MC_HEAD = "Choose the correct answer to the multiple-choice question."
MC_FORMAT = "Answer format: answer1/answer2/answer3/answer4/answer5"

# --- FIXED VALUES: benchmark catalog (task -> dataset, subset, split) -------------
BENCHMARK_CATALOG: dict[str, tuple[str, str | None, str]] = {
    "boolq": ("google/boolq", None, "validation"),
    "piqa": ("ybisk/piqa", None, "validation"),
    "social_i_qa": ("social_i_qa", None, "validation"),
    "hellaswag": ("Rowan/hellaswag", None, "validation"),
    "winogrande": ("allenai/winogrande", "winogrande_xl", "validation"),
    "ARC-Easy": ("allenai/ai2_arc", "ARC-Easy", "validation"),
    "ARC-Challenge": ("allenai/ai2_arc", "ARC-Challenge", "validation"),
    "openbookqa": ("allenai/openbookqa", "main", "validation"),
}

# --- FIXED VALUES: published paper rows (LLaMA2-7B, Table 1) ---------------------
PUBLISHED_REFERENCE: tuple[dict[str, object], ...] = (
    {
        "source": "DoRA paper Table 1",
        "method": "lora",
        "paper_method": "LoRA",
        "rank": 32,
        "params_percent": 0.83,
        "boolq": 0.698,
        "piqa": 0.799,
        "social_i_qa": 0.795,
        "hellaswag": 0.836,
        "winogrande": 0.826,
        "ARC-Easy": 0.798,
        "ARC-Challenge": 0.647,
        "openbookqa": 0.810,
        "macro_average": 0.776,
    },
    {
        "source": "DoRA paper Table 1",
        "method": "dora",
        "paper_method": "DoRA-dagger (Ours)",
        "rank": 16,
        "params_percent": 0.43,
        "boolq": 0.720,
        "piqa": 0.831,
        "social_i_qa": 0.799,
        "hellaswag": 0.891,
        "winogrande": 0.830,
        "ARC-Easy": 0.845,
        "ARC-Challenge": 0.710,
        "openbookqa": 0.812,
        "macro_average": 0.805,
    },
)
REPRODUCTION_RANK: dict[str, int] = {"lora": 32, "dora": 16}
REPRODUCTION_SOURCE = "Reproduction"
PAPER_METHOD_LABELS: dict[str, str] = {"lora": "LoRA", "dora": "DoRA"}
COMPARISON_METHOD_LABELS: dict[str, str] = {"LoRA": "LoRA (r=32)", "DoRA": "DoRA (r=16)"}

# --- FIXED VALUES: spec defaults when a snapshot omits a key ----------------------
SPEC_DEFAULTS: dict[str, object] = {
    "cutoff_len": 256,
    "trust_remote_code": False,
    "rank": 8,
    "alpha": 16,
    "dropout": 0.05,
    "use_4bit": False,
    "bnb_4bit_quant_type": "nf4",
    "bnb_4bit_compute_dtype": "bfloat16",
    "bnb_4bit_use_double_quant": True,
    "val_set_size": 120,
    "num_epochs": 3,
    "save_steps": 80,
    "eval_steps": 80,
    "weight_decay": 0.0,
    "train_on_inputs": False,
    "seed": 42,
    "max_new_tokens": 8,
}

# --- FIXED VALUES: presets (experiments, models, runtimes) ------------------------
# Experiment presets: scalar settings plus per-method overrides.
EXPERIMENT_PRESETS: dict[str, dict[str, object]] = {
    "default": {
        "task_names": TASKS, "rank": 8, "alpha": 16, "dropout": 0.05,
        "max_train_samples": None, "num_epochs": 3, "val_set_size": 120,
        "save_steps": 80, "eval_steps": 80, "weight_decay": 0.0,
        "train_on_inputs": False, "seed": 42, "max_new_tokens": 8,
        "method_overrides": {},
    },
    "debug_quick": {
        "task_names": ("boolq", "piqa"), "rank": 4, "alpha": 8, "dropout": 0.05,
        "max_train_samples": 512, "num_epochs": 1, "val_set_size": 16,
        "save_steps": 20, "eval_steps": 20, "weight_decay": 0.0,
        "train_on_inputs": False, "seed": 42, "max_new_tokens": 8,
        "method_overrides": {},
    },
    "paper_colab": {
        "task_names": TASKS, "rank": 8, "alpha": 16, "dropout": 0.05,
        "max_train_samples": None, "num_epochs": 3, "val_set_size": 120,
        "save_steps": 200, "eval_steps": 200, "weight_decay": 0.0,
        "train_on_inputs": False, "seed": 42, "max_new_tokens": 8,
        "method_overrides": {
            "lora": {"learning_rate": 3e-4, "rank": 32, "alpha": 64},
            "dora": {"rank": 16, "alpha": 32},
        },
    },
    "paper_llama2_7b": {
        "task_names": TASKS, "rank": 8, "alpha": 16, "dropout": 0.05,
        "max_train_samples": None, "num_epochs": 3, "val_set_size": 120,
        "save_steps": 200, "eval_steps": 200, "weight_decay": 0.0,
        "train_on_inputs": False, "seed": 42, "max_new_tokens": 8,
        "method_overrides": {
            "lora": {"learning_rate": 3e-4, "rank": 32, "alpha": 64},
            "dora": {"learning_rate": 2e-4, "rank": 16, "alpha": 32},
        },
    },
}
MODEL_PRESETS: dict[str, dict[str, object]] = {
    "llama2_7b": {"model_id": "meta-llama/Llama-2-7b-hf", "learning_rate": 2e-4,
                  "cutoff_len": 256, "trust_remote_code": False},
    "llama3_8b": {"model_id": "meta-llama/Meta-Llama-3-8B", "learning_rate": 1e-4,
                  "cutoff_len": 256, "trust_remote_code": False},
    "tiny_debug": {"model_id": "HuggingFaceTB/SmolLM2-135M", "learning_rate": 2e-4,
                   "cutoff_len": 256, "trust_remote_code": False},
}
RUNTIME_PRESETS: dict[str, dict[str, object]] = {
    "colab_a100_40gb_llama": {"per_device_batch_size": 8, "effective_batch_size": 16,
                              "gradient_checkpointing": False, "use_4bit": True},
    "colab_l4_llama": {"per_device_batch_size": 4, "effective_batch_size": 16,
                       "gradient_checkpointing": False, "use_4bit": True},
    "colab_t4": {"per_device_batch_size": 1, "effective_batch_size": 16,
                 "gradient_checkpointing": True, "use_4bit": True},
    "colab_t4_llama": {"per_device_batch_size": 1, "effective_batch_size": 16,
                       "gradient_checkpointing": True, "use_4bit": True},
    "official": {"per_device_batch_size": 1, "effective_batch_size": 1,
                 "gradient_checkpointing": False, "use_4bit": False},
}
DEFAULT_TRAIN_DATA_PATH = "data/commonsense_15k.json"

# --- FIXED VALUES: token ids used by sequence preparation ------------------------
PAD_ID = 0
BOS_ID = 1
EOS_ID = 2
UNK_ID = 3
IGNORE_INDEX = -100
TOKEN_PATTERN = r"(?U)\w+|[^\w\s]+"
