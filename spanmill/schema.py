"""Fixed values of the data model."""

from __future__ import annotations

#: State that a wait of this reason is in.
WAIT_STATES = {
    "chan send": "blocked (channel send)",
    "chan receive": "blocked (channel receive)",
    "network": "blocked (pollable I/O)",
    "runtime.GoSched": "inactive",
    "runtime.Gosched": "inactive",
    "select": "blocked (select)",
    "sleep": "inactive",
    "sync": "blocked (sync)",
    "sync.(*Cond).Wait": "blocked (sync.Cond)",
    "system goroutine wait": "inactive",
    "GC mark assist wait for work": "inactive",
    "GC background sweeper wait": "inactive",
    "preempted": "preempted",
    "forever": "stuck",
    "wait for debug call": "blocked (other)",
    "wait until GC ends": "blocked (GC)",
    "": "blocked (other)",
}

#: Root of a flame graph under which time in a state is shown; other states are not off the processor.
OFF_CPU = {
    "blocked (other)": "blocked",
    "blocked (channel send)": "send",
    "blocked (channel receive)": "recv",
    "blocked (select)": "select",
    "blocked (sync)": "sync",
    "blocked (sync.Once)": "sync.Once",
    "blocked (triggering GC)": "triggering GC",
    "blocked (sync.Cond)": "sync.Cond",
    "blocked (pollable I/O)": "I/O",
    "blocked (GC)": "GC",
    "blocked (syscall)": "blocking syscall",
}

#: Tag bits.
TAGS = {"network": 1, "TCP": 2, "TLS": 4, "read": 8, "accept": 16, "dial": 32, "HTTP": 64, "GC": 128}
#: The order in which tags are shown; GC is not.
TAG_ORDER = ["read", "accept", "dial", "network", "TCP", "TLS", "HTTP"]

#: Stack patterns. State, functions at fixed offsets ("" = any), functions anywhere, new state, frame offset, tag.
PATTERNS = [
    ("blocked (other)", ["runtime.ReadTrace"], [], "inactive", 0, None),
    ("blocked (channel receive)", ["runtime.chanrecv1"], [], None, 1, None),
    ("blocked (channel receive)", ["runtime.chanrecv2"], [], None, 1, None),
    ("blocked (channel send)", ["runtime.chansend1"], [], None, 1, None),
    ("blocked (sync)", ["runtime.gcStart"], [], "blocked (triggering GC)", 0, None),
    ("blocked (sync)", ["sync.(*Mutex).Lock", "sync.(*Once).doSlow", "sync.(*Once).Do"], [], "blocked (sync.Once)", 3, None),
    ("blocked (sync.Cond)", ["sync.(*Cond).Wait"], [], None, 1, None),
    ("blocked (pollable I/O)", ["internal/poll.(*FD).Read"], [], None, 1, "read"),
    ("blocked (pollable I/O)", ["internal/poll.(*FD).Read", "net.(*netFD).Read"], [], None, 2, "network"),
    ("blocked (pollable I/O)", ["internal/poll.(*FD).Accept"], [], None, 1, "accept"),
    ("blocked (pollable I/O)", ["internal/poll.(*FD).Accept", "net.(*netFD).accept"], [], None, 2, "network"),
    ("blocked (pollable I/O)", ["internal/poll.(*FD).Accept", "", "net.(*TCPListener).accept", "net.(*TCPListener).Accept"], [], None, 4, "TCP"),
    ("blocked (pollable I/O)", [], ["net.(*sysDialer).dialSingle"], None, 0, "dial"),
    ("blocked (pollable I/O)", [], ["net.(*sysDialer).dialTCP"], None, 0, "TCP"),
    ("blocked (pollable I/O)", [], ["crypto/tls.(*Conn).readFromUntil"], None, 0, "TLS"),
    ("blocked (pollable I/O)", [], ["crypto/tls.(*listener).Accept"], None, 0, "TLS"),
    ("blocked (pollable I/O)", [], ["net/http.(*connReader).Read"], None, 0, "HTTP"),
    ("blocked (pollable I/O)", [], ["net/http.(*persistConn).Read"], None, 0, "HTTP"),
    ("blocked (pollable I/O)", [], ["net/http.(*http2clientConnReadLoop).run"], None, 0, "HTTP"),
    ("blocked (pollable I/O)", [], ["net/http.(*Server).Serve"], None, 0, "HTTP"),
    ("blocked (select)", [], [], None, 1, None),
]

_BLOCKED_ONLY_READY = [
    "blocked (other)", "blocked (channel send)", "blocked (channel receive)", "blocked (select)", "blocked (sync)", "blocked (sync.Once)",
    "blocked (triggering GC)", "blocked (sync.Cond)", "blocked (pollable I/O)", "blocked (GC)", "blocked (syscall)",
]
_GC_WORKER = ["ready", "inactive", "blocked (sync)"]
#: States that may follow a state.
LEGAL_NEXT = {
    "inactive": ["active", "ready", "blocked (syscall)", "GC (mark assist)"],
    "active": ["ready", "inactive", *_BLOCKED_ONLY_READY, "stuck", "GC (mark assist)", "GC (sweep assist)"],
    "GC (idle)": _GC_WORKER,
    "GC (dedicated)": _GC_WORKER,
    "GC (fractional)": _GC_WORKER,
    "created": ["active", "inactive", "blocked (other)", "blocked (syscall)"],
    "ready": ["active", "GC (mark assist)", "GC (idle)", "GC (dedicated)", "GC (fractional)"],
    **{s: ["ready"] for s in _BLOCKED_ONLY_READY},
    "GC (mark assist)": ["ready", "active", "inactive", "blocked (other)", "blocked (sync)", "blocked (GC)"],
    "GC (sweep assist)": ["active"],
}
