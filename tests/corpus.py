"""Small ports written for the tests, each with planted differences."""

LAMP_CC = '''#include "lamp.h"

constexpr uint32_t kMaxLevel = 7;
#define LAMP_ON_BIT (1 << 3)

// Turns the lamp on at |level|.
zx_status_t Lamp::TurnOn(uint32_t level) {
  if (level > kMaxLevel) {
    return ZX_ERR_INVALID_ARGS;
  }
  Guard<Mutex> guard{&lock_};
  // Power comes first.
  zx_status_t status = PowerUp(level);
  if (status != ZX_OK) {
    return status;
  }
  SetFlags(LAMP_ON_BIT);
  return ZX_OK;
}

// Turns the lamp off.
void Lamp::TurnOff() {
  Guard<Mutex> guard{&lock_};
  // Never leave the fan running.
  StopFan();
  PowerDown();
}

zx_status_t Lamp::ReadLevel(uint32_t* out) {
  DEBUG_ASSERT(out != nullptr);
  if (!powered_) {
    return ZX_ERR_BAD_STATE;
  }
  LTRACEF("level");
  *out = level_;
  return ZX_OK;
}

uint32_t Lamp::Blend(uint32_t a, uint32_t b) {
  switch (mode_) {
    case Mode::kSum:
      return Add(a, b);
    case Mode::kMax:
      return Pick(a, b);
    default:
      panic("mode");
  }
}
'''

LAMP_RS_FAITHFUL = '''const MAX_LEVEL: u32 = 7;
const LAMP_ON_BIT: u32 = 1 << 3;

impl Lamp {
    /// Turns the lamp on at `level`.
    pub fn turn_on(&self, level: u32) -> Result<(), Status> {
        if level > MAX_LEVEL {
            return Err(Status::INVALID_ARGS);
        }
        let _guard = self.lock.lock();
        // Power comes first.
        self.power_up(level)?;
        self.set_flags(LAMP_ON_BIT);
        Ok(())
    }

    /// Turns the lamp off.
    pub fn turn_off(&self) {
        let _guard = self.lock.lock();
        // Never leave the fan running.
        self.stop_fan();
        self.power_down();
    }

    pub fn read_level(&self, out: &mut u32) -> Result<(), Status> {
        debug_assert!(self.powered);
        if !self.powered {
            return Err(Status::BAD_STATE);
        }
        ltracef!("level");
        *out = self.level;
        Ok(())
    }

    pub fn blend(&self, a: u32, b: u32) -> u32 {
        match self.mode {
            Mode::Sum => self.add(a, b),
            Mode::Max => self.pick(a, b),
        }
    }
}
'''

LAMP_RS_PLANTED = (
    LAMP_RS_FAITHFUL.replace("Status::INVALID_ARGS", "Status::OUT_OF_RANGE")
    .replace("        // Never leave the fan running.\n", "")
    .replace('        ltracef!("level");\n', "")
    .replace("        self.set_flags(LAMP_ON_BIT);\n", "        self.set_flags(0);\n")
)

FILES = {
    "faithful": [("k/lamp.cc", LAMP_CC), ("k/lamp.rs", LAMP_RS_FAITHFUL)],
    "planted": [("k/lamp.cc", LAMP_CC), ("k/lamp.rs", LAMP_RS_PLANTED)],
    "classes": [
        ("k/shape.cc", '''class Shape {
 public:
  // Draws the shape |n| times.
  virtual zx_status_t Draw(uint32_t n);
};
class Circle : public Shape {
  zx_status_t Draw(uint32_t n);
};
zx_status_t Shape::Draw(uint32_t n) {
  Prepare(n);
  return ZX_OK;
}
zx_status_t Circle::Draw(uint32_t n) {
  DrawArc(n);
  return ZX_OK;
}
'''),
        ("k/shape.rs", '''impl Shape {
    /// Draws the shape `n` times.
    pub fn draw(&self, n: u32) -> Result<(), Status> {
        self.prepare(n);
        match self.kind {
            Kind::Circle => self.draw_arc(n),
            Kind::Plain => {}
        }
        Ok(())
    }
}
'''),
    ],
    "duplicates": [
        ("k/probe.cc", "uint32_t probe_read(uint32_t at) {\n  uint32_t raw = Fetch(at);\n  Trace(raw);\n  return Mask(raw);\n}\nuint32_t probe_peek(uint32_t at) {\n  Lock(at);\n  return Glance(at);\n}\n"),
        ("k/probe.rs", "pub fn probe_read(at: u32) -> u32 {\n    let raw = fetch(at);\n    trace(raw);\n    mask(raw)\n}\npub fn probe_peek(at: u32) -> u32 {\n    lock(at);\n    glance(at)\n}\n"),
        ("k/probe_fast.rs", "pub fn probe_read(at: u32) -> u32 {\n    let raw = fetch(at);\n    trace(raw);\n    raw\n}\n"),
    ],
    "arch": [
        ("k/arch/x86/timer.cc", "void timer_arm(uint32_t n) {\n  WriteX(n);\n  Flush(n);\n  Settle(n);\n}\n"),
        ("k/arch/riscv64/timer.cc", "void timer_arm(uint32_t n) {\n  WriteX(n);\n  Flush(n);\n  Settle(n);\n}\n"),
        ("k/arch/x86/src/timer.rs", "pub fn timer_arm(n: u32) {\n    write_x(n);\n    flush(n);\n    settle(n);\n}\n"),
    ],
    "renamed": [
        ("k/store.cc", "zx_status_t Store::FlushPages(uint32_t n) {\n  if (n == 0) {\n    return ZX_ERR_INVALID_ARGS;\n  }\n  WriteBack(n);\n  Notify(n);\n  return ZX_OK;\n}\n"),
        ("k/store.rs", "impl Store {\n    pub fn flush_all_pages(&self, n: u32) -> Result<(), Status> {\n        if n == 0 {\n            return Err(Status::INVALID_ARGS);\n        }\n        self.write_back(n);\n        self.notify(n);\n        Ok(())\n    }\n}\n"),
    ],
    "flow": [
        ("k/gate.cc", '''zx_status_t Gate::Open(Mode mode, uint32_t n) {
  if (n > limit_) {
    return ZX_ERR_OUT_OF_RANGE;
  }
  if (mode == blocked_) {
    return ZX_ERR_OUT_OF_RANGE;
  }
  switch (mode) {
    case Mode::Slow:
      RunSlow(n);
      break;
    case Mode::Fast:
      RunFast(n);
      break;
    default:
      RunIdle(n);
  }
#if WITH_TURBO_BOOST
  Boost(n);
#endif
  return ZX_OK;
}
zx_status_t Gate::Close(uint32_t n) {
  DEBUG_ASSERT(IsShut(n));
  Seal(n);
  count_.store(n);
  return ZX_OK;
}
'''),
        ("k/gate.rs", '''impl Gate {
    pub fn open(&self, mode: Mode, n: u32) -> Result<(), Status> {
        if n > self.limit || mode == self.blocked {
            return Err(Status::OUT_OF_RANGE);
        }
        if mode == Mode::Slow {
            self.run_slow(n);
        } else if mode == Mode::Fast {
            self.run_fast(n);
        } else {
            self.run_idle(n);
        }
        self.boost(n);
        Ok(())
    }
    pub fn close(&self, n: u32) -> Result<(), Status> {
        if self.broken.is_set() {
            return Err(Status::BAD_STATE);
        }
        self.is_shut(n);
        self.seal(n);
        self.count.store(n, Ordering::Relaxed);
        Ok(())
    }
}
'''),
    ],
    "macros": [
        ("k/copy.cc", '''#define COPY_PAIR(out, in) \\
  do {                     \\
    (out)->a = (in)->a;    \\
  } while (0)

void copy_frame(Out* out, In* in) {
  COPY_PAIR(out, in);
  Commit(out);
}
'''),
        ("k/copy.rs", "pub fn copy_frame(out: &mut Out, inp: &In) {\n    out.a = inp.a;\n    commit(out);\n}\n"),
    ],
    "lints": [
        ("k/raw.rs", '''// Ported from raw.cc.
pub fn poke(buf: &mut Buf) -> u32 {
    let p = buf.as_mut_ptr();
    let q = unsafe { &mut *p };
    q.touch()
}
pub unsafe fn bare(x: u32) -> u32 {
    x
}
/// Fine.
///
/// # Safety
///
/// `x` is valid.
pub unsafe fn documented(x: u32) -> u32 {
    x
}
unsafe impl Send for Raw {}
extern "C" {
    fn _ZN4Lamp4DrawEi(n: i32);
}
pub fn covered() {
    // SAFETY: nothing is touched.
    unsafe { nothing() };
}
#[no_mangle]
pub extern "C" fn rust_raw_pick(n: u32) -> u32 {
    if n > 3 {
        return two(n);
    }
    one(n)
}
'''),
        ("k/dense.rs", "pub fn dense() {\n" + "".join(f"    // SAFETY: step {i}.\n    unsafe {{ step{i}() }};\n" for i in range(10)) + "}\n"),
    ],
    "chain": [("k/chain.rs", """// Ported from chain.cc.
pub fn far(buf: &mut Buf) -> u32 {
    let a = buf.as_mut_ptr();
    let b = a.cast::<u8>();
    let c = b.add(1);
    let d = c.offset(2);
    let e = d.cast::<u32>();
    let f = e.add(3);
    // SAFETY: the buffer is long enough.
    let g = unsafe { &mut *f };
    g.touch()
}
""")],
    "lookup": [("k/dial.rs", "pub fn dial_turn(n: u32) -> u32 {\n    let raw = sense(n);\n    settle(raw);\n    scale(raw)\n}\n")],
}

REPO = [("lookup", "k/dial.cc", "// Turns the dial.\nuint32_t dial_turn(uint32_t n) {\n  uint32_t raw = Sense(n);\n  Settle(raw);\n  return Scale(raw);\n}\n"),
        ("lookup", "k/arch/x86/other.cc", "void other(void) {\n  Nothing();\n}\n")]

BEFORE = {
    "ffi": [("k/fan.cc", "zx_status_t Fan::SetSpeed(uint32_t n) {\n  if (n > 9) {\n    return ZX_ERR_INVALID_ARGS;\n  }\n  Spin(n);\n  Report(n);\n  return ZX_OK;\n}\nvoid Fan::Keep() {\n  Stay(1);\n  Stay(2);\n}\n"),
            ("k/fan.h", "class Fan {\n public:\n  zx_status_t SetSpeed(uint32_t n);\n};\n")],
}
AFTER = {
    "ffi": [("k/fan.cc", "zx_status_t Fan::SetSpeed(uint32_t n) {\n  return rust_fan_set_speed(this, n);\n}\nvoid Fan::Keep() {\n  Stay(1);\n  Stay(3);\n}\n"),
            ("k/fan.h", "extern \"C\" zx_status_t rust_fan_set_speed(Fan* fan, uint64_t n);\nclass Fan {\n public:\n  zx_status_t SetSpeed(uint32_t n);\n};\n"),
            ("k/fan_ffi.rs", "#[no_mangle]\npub extern \"C\" fn rust_fan_set_speed(fan: *mut Fan, n: u32) -> i32 {\n    fan.change_speed(n)\n}\n"),
            ("k/fan.rs", "impl Fan {\n    pub fn change_speed(&self, n: u32) -> Result<(), Status> {\n        if n > 9 {\n            return Err(Status::INVALID_ARGS);\n        }\n        self.spin(n);\n        self.report(n);\n        Ok(())\n    }\n}\n")],
}
